"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, on Spark's default file system where it names none; a local one, gone
    at exit, only where that is unset (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return qualified(spark, named)
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="graphmill-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark would use for it, without a slash at its end."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole
