"""Prefix search over a sorted table of terms: files by range, and the first and last term of each beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.operators.reader import SEARCHED, node_label, search_order, visible_nodes

TERMS = T.StructType([T.StructField(c, T.StringType()) for c in ("term", "id", "place", "type", "label")])


def terms(nodes: DataFrame) -> DataFrame:
    """(term, id, place, type, label): each visible node under what a prefix search compares, place being its order in the result."""
    held = F.array_distinct(F.array(*(F.lower(c) for c in SEARCHED)))
    return visible_nodes(nodes).select(F.explode(held).alias("term"), "id", search_order().alias("place"), F.col("node_type").alias("type"), node_label().alias("label")).filter("term is not null")


def write_terms(rows: DataFrame, where: str, files: int) -> None:
    """Files by range of term and id, so that a term of very many nodes fills several, and (file, low, high, n) of each."""
    rows.select(*TERMS.names).repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{where}/terms")
    written = rows.sparkSession.read.schema(TERMS).parquet(f"{where}/terms").select("term", F.col("_metadata.file_name").alias("file"))
    fences = written.groupBy("file").agg(F.min("term").alias("low"), F.max("term").alias("high"), F.count("*").alias("n"))
    fences.coalesce(1).write.mode("overwrite").parquet(f"{where}/fences")


def size_of(spark: SparkSession, where: str) -> int:
    return spark.read.schema("file string, low string, high string, n long").parquet(f"{where}/fences").agg(F.sum("n")).first()[0] or 0


def with_prefix(spark: SparkSession, where: str, prefix: str) -> DataFrame:
    """The rows whose term starts with the prefix, from the files that can hold one. What the driver sees is a name a file."""
    fences = spark.read.schema("file string, low string, high string, n long").parquet(f"{where}/fences")
    able = fences.filter((F.substring("low", 1, len(prefix)) <= prefix) & (F.col("high") >= prefix))
    paths = sorted(f"{where}/terms/{r.file}" for r in able.select("file").collect())
    if not paths:
        return spark.createDataFrame([], TERMS)
    return spark.read.schema(TERMS).parquet(*paths).filter(F.startswith("term", F.lit(prefix)))


def newest(layers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows of layers (rows, touched ids), oldest first, without those whose id a later layer touched."""
    rows = touched = None
    for k, (held, ids) in enumerate(layers):
        held, ids = held.withColumn("layer", F.lit(k)), ids.select("id", F.lit(k).alias("since"))
        rows = held if rows is None else rows.unionByName(held)
        touched = ids if touched is None else touched.unionByName(ids)
    if len(layers) == 1:
        return rows.drop("layer")
    last = touched.groupBy("id").agg(F.max("since").alias("since"))
    return rows.join(last, "id", "left").filter("since is null or layer >= since").select(*TERMS.names)
