"""A stored inverted-file index of vectors: cells around centres, several of which a query looks into; what it finds is scored exactly."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.operators.retrieval import TopScores, matrix_of, nearest, unit
from graphmill.operators.traversal import cut

#: Vectors that the centres are fitted to, and queries that the number of cells to look into is measured with, whatever the table's size.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 200
#: The most cells, and the vectors of a cell that one task compares at once; a larger cell is split.
MOST_CELLS, PART_ROWS = 4096, 8192


@dataclass
class VectorIndex:
    """Where the index lies, its centres, how many parts each cell has, and how many cells a query needs for the recall asked for."""

    folder: str
    centres: np.ndarray
    parts: list[int]
    probes: int
    recall: float

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/vectors")


def ranked_cells(vectors: DataFrame, centres: np.ndarray, column: str, most: int) -> DataFrame:
    """vectors with `cells`, the numbers of the cells that they are nearest to, nearest first. The centres are of a bounded number."""
    import pyarrow as pa

    width = centres.shape[1]

    def work(batches):
        for batch in batches:
            at, rows = matrix_of(batch.column(column), width)
            order = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :most]
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*kept.schema.names, "cells"])

    return vectors.mapInArrow(work, T.StructType([*vectors.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def build_index(vectors: DataFrame, folder: str, id_col: str = "id", column: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex:
    """Assigns every vector to the cell of its nearest centre and stores them by cell; (id, v, cell, part).

    Centres are k-means centres of SAMPLE_ROWS vectors at most, chosen by a hash of their id; there are about as many as the square root of the number of
    vectors. `probes` is the least number of cells in which SAMPLE_QUERIES of the vectors find `recall` of their k nearest, as an exact
    search of all vectors has it. Vectors without length are left out, as are those of another length than most. Rows of a hot cell are split into
    parts of about PART_ROWS.
    """
    base = cut(unit(vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")), "v"))
    width = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        raise ValueError("there are no vectors to index")
    base = base.filter(F.size("v") == width.n)
    cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(width["count"]))))
    sample = base.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS)
    fitted = KMeans(k=max(2, cells), seed=7, maxIter=10, distanceMeasure="cosine", featuresCol="x").fit(sample.select(array_to_vector("v").alias("x")))
    centres = np.array([c / max(np.linalg.norm(c), 1e-300) for c in fitted.clusterCenters()])
    placed = ranked_cells(base, centres, "v", 1).select("id", "v", F.col("cells")[0].alias("cell"))
    placed = cut(placed)
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = [max(1, math.ceil(sizes.get(c, 0) / PART_ROWS)) for c in range(len(centres))]
    split = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)).cast("int"))
    tasks = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Sorted by cell, so that a filter on cells skips the row groups of others.
    split.repartitionByRange(tasks, "cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{folder}/vectors")
    index = VectorIndex(folder, centres, parts, len(centres), 1.0)
    index.probes, index.recall = needed_probes(index, base.sparkSession, recall, k)
    write_meta(base.sparkSession, index)
    return index


def needed_probes(index: VectorIndex, spark: SparkSession, recall: float, k: int) -> tuple[int, float]:
    """(cells to look into, share of true neighbours found there), measured against the exact search."""
    rows = index.rows(spark)
    asked = rows.orderBy(F.xxhash64("id", F.lit("query"))).limit(SAMPLE_QUERIES).select(F.col("id").alias("query"), F.col("v").alias("vector"))
    true = nearest(asked, rows, k, "id", "v").select("query", "id").join(rows.select("id", "cell"), "id")
    order = ranked_cells(asked, index.centres, "vector", len(index.centres))
    places = true.join(order, "query").select(F.array_position("cells", F.col("cell")).alias("place")).groupBy("place").count().orderBy("place").collect()
    total, found = sum(r["count"] for r in places), 0
    for r in places:
        found += r["count"]
        if found >= recall * total:
            return int(r.place), found / total
    return len(index.centres), 1.0


def write_meta(spark: SparkSession, index: VectorIndex) -> None:
    rows = [(json.dumps({"centres": index.centres.tolist(), "parts": index.parts, "probes": index.probes, "recall": index.recall}),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{index.folder}/about")


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return VectorIndex(folder, np.array(about["centres"]), about["parts"], about["probes"], about["recall"])


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, id, score, rank) from the cells nearest to each query: approximate, but for scores, which are exact. With as many probes as cells it is
    the exact search. Queries meet the parts of their cells, each a product of two matrices in a task."""
    import pyarrow as pa

    spark = queries.sparkSession
    asked = unit(queries.select("query", "vector"), "vector")
    looked = cut(ranked_cells(asked, index.centres, "vector", probes or index.probes).select("query", "vector", F.explode("cells").alias("cell")))
    wanted = [r.cell for r in looked.select("cell").distinct().collect()]
    rows = index.rows(spark).filter(F.col("cell").isin(wanted))
    parts = F.element_at(F.array(*map(F.lit, index.parts)), F.col("cell") + 1)
    spread = looked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    id_type = index.rows(spark).schema["id"].dataType
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    width = index.centres.shape[1]

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table({"query": asking.column("query").slice(0, 0), "id": held.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(asking) or not len(held):
            return none
        top = TopScores(asking.column("query").combine_chunks(), matrix_of(asking.column("vector").combine_chunks(), width)[1], k)
        for batch in held.to_batches(max_chunksize=4096):
            top.add(batch.column("id"), matrix_of(batch.column("v"), width)[1])
        return top.rows() or none

    found = spread.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(score, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
