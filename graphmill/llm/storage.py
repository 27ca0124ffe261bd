"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphmill.sources.shared import shared_folder

#: Names that Hadoop gives to stores which Arrow knows by another.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Narrow rows that are worth a file of their own. Each file of a table costs round trips to its store, and on a local one without native code
#: a process that the executor forks.
FILE_ROWS = 1 << 18


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder; it exists once something is written to it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut, and a lost executor costs nothing.

    rows: about how many narrow rows it has at most, where that is known; then it is written by a task for each core, or for each FILE_ROWS if
    these are more, however many partitions shuffles have. Only for plans whose last step is a cheap one after a shuffle.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS)))
    where = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(where)
    back = spark.read.schema(df.schema).parquet(where)
    back.graphmill_folder = where
    return back


def discard(df: DataFrame) -> None:
    """Removes a table made by stored() that no later plan reads."""
    remove(df.sparkSession, df.graphmill_folder)


def remove(spark: SparkSession, uri: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(uri: str):
    """(file system, path) of a URI, for worker-side reads and writes of plain files."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    found, path = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")
    return found, path


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    holder = sys.modules.setdefault("_graphmill_worker_state", types.ModuleType("_graphmill_worker_state"))
    return holder.__dict__.setdefault("kept", {})


def local_copy(uri: str) -> str:
    """A path that can be memory-mapped: the file itself where its store is a mounted folder, else a copy in the worker's temp folder."""
    where, path = opened(uri)
    if where.type_name == "local":
        return path
    kept = worker_state().setdefault("copies", {})
    if uri not in kept:
        if "copy_dir" not in worker_state():
            worker_state()["copy_dir"] = tempfile.mkdtemp(prefix="graphmill-map-")
            atexit.register(shutil.rmtree, worker_state()["copy_dir"], True)
        target = os.path.join(worker_state()["copy_dir"], uuid.uuid4().hex)
        with where.open_input_stream(path) as source, open(target, "wb") as sink:
            shutil.copyfileobj(source, sink, 1 << 22)
        kept[uri] = target
    return kept[uri]
