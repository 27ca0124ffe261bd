"""Vector retrieval: exact nearest neighbours, best per node, rerank and fill."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions.models import RerankModel, checked_scores
from graphmill.functions.scalar import dot, similarity
from graphmill.operators.reader import VISIBLE_NODE_TYPES, node_label

if TYPE_CHECKING:
    import pyarrow as pa

#: About so many queries are searched at once: a block of them is sent to all workers.
MOST_QUERIES = 1000
#: A product of matrices may be off by so much; so many candidates are scored again at once.
SLACK, CHECKED = 1e-9, 1 << 16
#: So many products, 8 bytes each, are held at once, however many rows an Arrow batch has.
HELD_SCORES = 1 << 20


def unit(vectors: DataFrame, column: str) -> DataFrame:
    """vectors with `column` scaled to length one; those without length are left out."""
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    return vectors.withColumn("norm", norm).filter("norm > 0").withColumn(column, F.expr(f"transform({column}, x -> cast(x as double) / norm)")).drop("norm")


class TopScores:
    """The k highest products of each query with the vectors seen so far, ties to the smaller id. Candidates come from one product of
    matrices and are scored again one by one, so equal vectors have equal scores wherever they stand."""

    def __init__(self, names: pa.Array, vectors: np.ndarray, k: int):
        self.names, self.vectors, self.k, self.held = names, vectors, k, None

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        if not len(self.vectors):
            return
        step = max(1, HELD_SCORES // len(self.vectors))
        for at in range(0, len(rows), step):
            self._add(ids[at : at + step], rows[at : at + step])

    def _add(self, ids: pa.Array, rows: np.ndarray) -> None:
        import pyarrow as pa

        score = self.vectors @ rows.T
        if score.shape[1] > self.k:
            least = np.partition(score, -self.k, axis=1)[:, -self.k]
        else:
            least = np.full(len(score), -np.inf)
        query, at = np.nonzero(score >= least[:, None] - SLACK)
        exact = np.concatenate([(self.vectors[query[i : i + CHECKED]] * rows[at[i : i + CHECKED]]).sum(axis=1) for i in range(0, len(query), CHECKED)])
        found = pa.table({"query": pa.array(query), "id": ids.take(pa.array(at)), "score": exact})
        both = found if self.held is None else pa.concat_tables([self.held, found])
        both = both.take(pa.compute.sort_indices(both, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
        query = both.column("query").to_numpy()
        self.held = both.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < self.k))

    def rows(self) -> pa.Table | None:
        """(query, id, score)."""
        return None if self.held is None else self.held.set_column(0, "query", self.names.take(self.held.column("query").combine_chunks()))


def matrix_of(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lists of that length, their values as rows)."""
    at = np.flatnonzero(np.diff(column.offsets.to_numpy()) == width)
    held = column.take(at)
    return at, held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(query, id, score, rank): the k vectors nearest to each query by cosine, ties by id.

    queries: query, vector; any number. They are dealt to blocks of about MOST_QUERIES by a hash of `query`, and each block
    goes to every task, which multiplies it with its vectors batch by batch and keeps k rows a query; so what moves is k rows for
    each query and partition.
    """
    import pyarrow as pa

    asked = unit(queries.select("query", "vector"), "vector")
    blocks = math.ceil(asked.count() / MOST_QUERIES)
    base = unit(vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")), "v")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def found(block: DataFrame) -> DataFrame:
        # A block of a bounded number of queries; vectors of several lengths are products of their own.
        table = block.toArrow()
        column = table.column("vector").combine_chunks()
        parts = []
        for width in np.unique(np.diff(column.offsets.to_numpy())).tolist():
            at, rows = matrix_of(column, width)
            parts.append((width, table.column("query").combine_chunks().take(pa.array(at)), rows))

        def score(batches):
            tops = [(width, TopScores(names, rows, k)) for width, names, rows in parts]
            for batch in batches:
                for width, top in tops:
                    at, rows = matrix_of(batch.column("v"), width)
                    top.add(batch.column("id").take(pa.array(at)), rows)
            for _, top in tops:
                if (out := top.rows()) is not None:
                    yield from out.to_batches()

        scored = base.mapInArrow(score, schema)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if blocks <= 1:
        return found(asked)
    number = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [found(asked.filter(number == b)) for b in range(blocks)])


def seed_candidates(hits: DataFrame, nodes: DataFrame, edges: DataFrame, embedding_model: str | None = None, dimensions: int | None = None, query_order: str = "query") -> DataFrame:
    """Candidates for reranking: (id, type, label, text, summary_id, vector_score, first_seen), one row per described node.

    Filters follow the top-k, so fewer than k may be left. A node's content is that of its best score, the first on a tie;
    its place is that of its first appearance over the queries in order.
    """
    summary = nodes.filter((F.col("node_type") == "Summary") & (F.col("purpose") == "retrieval"))
    if embedding_model is not None:
        summary = summary.filter(F.col("embedding_model") == embedding_model)
    if dimensions is not None:
        summary = summary.filter(F.col("embedding_dimensions") == dimensions)
    known = hits.join(summary.select("id", "text"), "id").select(query_order, "rank", F.col("id").alias("summary_id"), "text", similarity(1.0 - F.col("score")).alias("vector_score")).filter("vector_score > 0")
    described = edges.filter(F.col("edge_type") == "DESCRIBES").select(F.col("source_id").alias("summary_id"), F.col("target_id").alias("id"))
    target = nodes.filter(F.col("node_type").isin(*VISIBLE_NODE_TYPES)).select("id", F.col("node_type").alias("type"), node_label().alias("label"))
    rows = known.join(described, "summary_id").join(target, "id")
    seen = F.struct(F.col(query_order), "rank", "summary_id")
    best = rows.groupBy("id", "type", "label").agg(
        F.min_by(F.struct("text", "summary_id", "vector_score"), F.struct((-F.col("vector_score")).alias("low"), seen.alias("seen"))).alias("best"), F.min(seen).alias("first_seen")
    )
    place = F.row_number().over(Window.orderBy("first_seen"))
    return best.select("id", "type", "label", "best.text", "best.summary_id", "best.vector_score", (place - 1).alias("index"))


def reranked(candidates: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """The top_n candidates after reranking: (id, ..., rerank_score), by (rerank score, vector score, label).

    scores: index, rerank_score; unknown indexes are skipped. If they name fewer than wanted, the rest is filled with the
    best of the others by (vector score, label); a candidate without a score sorts as -1.
    """
    joined = candidates.join(scores.select("index", "rerank_score"), "index", "left")
    fill = Window.orderBy(F.col("rerank_score").isNull(), F.when(F.col("rerank_score").isNull(), -F.col("vector_score")), F.when(F.col("rerank_score").isNull(), F.col("label")), "index")
    chosen = joined.withColumn("turn", F.row_number().over(fill)).filter((F.col("turn") <= top_n) | F.col("rerank_score").isNotNull()).drop("turn")
    return chosen.orderBy(F.desc(F.coalesce("rerank_score", F.lit(-1.0))), F.desc("vector_score"), "label", "id").limit(top_n)


def rerank(candidates: DataFrame, query: str, scorer: Callable[[str, list[str], int], list[tuple[int, float]]], top_n: int) -> DataFrame:
    """reranked() with scores from a model on the driver: the candidates are at most k per query text, already."""
    rows = candidates.orderBy("index").select("index", "text").collect()
    n = min(top_n, len(rows))
    found = scorer(query, [r.text for r in rows], n) if rows else []
    scores = candidates.sparkSession.createDataFrame([(int(i), float(s)) for i, s in found if 0 <= i < len(rows)], "index int, rerank_score double")
    return reranked(candidates, scores, top_n)


def scored(rows: DataFrame, query: str, model: RerankModel, batch: int = 100) -> DataFrame:
    """rows (..., text) with `score` by the model, asked for all scores of at most `batch` texts at a time on the executors;
    an answer that names a text twice, none or one that was not asked about is an error."""
    import pyarrow as pa

    def ask(batches):
        for part in batches:
            texts, out = part.column("text").to_pylist(), []
            for at in range(0, len(texts), batch):
                asked = texts[at : at + batch]
                found = checked_scores(model.score(query, asked, len(asked)), len(asked))
                out += [found[i] for i in range(len(asked))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*part.schema.names, "score"])

    return rows.mapInArrow(ask, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
