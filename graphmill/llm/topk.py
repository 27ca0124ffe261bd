"""Exact top-k inner products: vectors in buckets of one length, each searched by the pruning that its local cosine thresholds favour."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.storage import discard, stored

#: Rows that are compared at once have about so many components: of a bucket, of a group of buckets, of a block of queries, and of the seeds.
BUCKET_COMPONENTS, GROUP_COMPONENTS, BLOCK_COMPONENTS, SEED_COMPONENTS = 1 << 16, 1 << 19, 1 << 16, 1 << 18
#: Classes of length (or of the length that a query needs); large ones are split further by a hash.
CLASSES = 256
#: A bucket ends where a vector has less than this share of its greatest length.
NARROW = 0.9
#: Coordinates that the coordinate pruning looks at, and how much more a candidate it leaves costs than a row of a product.
FOCUS, GATHER_COST = 4, 8
#: Sums below this are exact as doubles.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SLACK = 1e-9


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of integer rows; bound: of their lengths' product. Those beyond a long are the largest or least long."""
    if bound < EXACT:
        return np.rint(q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


class Best:
    """The k best of each query so far: score descending, then id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.n, self.k, self.least = n, k, least.copy()
        self.query, self.score, self.id = (np.empty(0, np.int64),) * 3
        #: The id that an equal score has to be below.
        self.last = np.full(n, MOST)

    def wanted(self, query, score, ids) -> np.ndarray:
        return (score > self.least[query]) | ((score == self.least[query]) & (ids <= self.last[query]))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]
        full = rank == self.k - 1
        higher = score[full] >= self.least[query[full]]
        self.least[query[full][higher]], self.last[query[full][higher]] = score[full][higher], ids[full][higher]


class Bucket:
    """Vectors of nearly one length, longest first, and per coordinate the order of their unit vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, lengths: np.ndarray):
        self.rows, self.ids, self.keys, self.lengths = rows, ids, keys, lengths
        self.unit = self.order = self.sorted = None

    def coordinates(self) -> None:
        if self.unit is None:
            self.unit = self.rows / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
            self.order = np.argsort(self.unit, axis=0)
            self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def search(self, best: Best, q: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> None:
        """Adds what the bucket has for the queries q. A query's local threshold is the least cosine that any vector of
        this bucket needs to reach its k-th best score so far: above 1 the bucket has nothing for it. A vector shorter than that score over the query's length has nothing
        either; near a high threshold all unit vectors also agree with the query's within an interval on each coordinate."""
        most = float(self.lengths[0])
        bound = most * float(lengths.max(initial=0)) * 1.0001
        least = best.least.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, least / lengths, 0.0) * (1 - SLACK)
            local = np.where(least > 0, need / most, -1.0) if most else np.where(least > 0, 2.0, -1.0)
        prefix = np.searchsorted(-self.lengths, -need, side="right") if bound < EXACT else np.full(len(q), len(self.rows))
        alive = np.flatnonzero(prefix > 0)
        by_coordinate = np.zeros(len(q), bool)
        spans: dict[int, tuple] = {}
        if bound < EXACT and q.shape[1] >= FOCUS:
            hopeful = alive[(local[alive] > 0.5) & (prefix[alive] > GATHER_COST)]
            if len(hopeful):
                spans = self.spans(q[hopeful] / lengths[hopeful, None], local[hopeful], hopeful)
                for k, (_, low, high, _) in spans.items():
                    by_coordinate[k] = (high - low) * GATHER_COST < prefix[k]
        plain = alive[~by_coordinate[alive]]
        plain = plain[np.argsort(prefix[plain], kind="stable")]
        for part in np.array_split(plain, math.ceil(len(plain) / 256)) if len(plain) else ():
            rows = int(prefix[part[-1]])
            score = products(q[part], self.rows[:rows], bound)
            at, of = np.nonzero((score >= best.least[part][:, None]) & (self.keys[:rows][None, :] != keys[part][:, None]))
            fits = best.wanted(part[at], score[at, of], self.ids[of])
            best.add(part[at][fits], score[at, of][fits], self.ids[of][fits])
        verified = []
        for k in np.flatnonzero(by_coordinate):
            rows = self.candidates(*spans[int(k)], prefix[k])
            rows = rows[self.keys[rows] != keys[k]]
            verified.append((np.full(len(rows), k), products(q[k : k + 1], self.rows[rows], bound)[0], self.ids[rows]))
        if verified:
            query, score, ids = (np.concatenate(x) for x in zip(*verified))
            fits = best.wanted(query, score, ids)
            best.add(query[fits], score[fits], ids[fits])

    def spans(self, unit: np.ndarray, local: np.ndarray, names: np.ndarray) -> dict[int, tuple]:
        """Per query (coordinate, first, end, filter) of the narrowest interval that the threshold leaves on one of its FOCUS largest
        coordinates; filter: the focus, the query's part there, the rest of its length, and the threshold."""
        self.coordinates()
        t = np.clip(local, -1.0, 1.0)
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        x = np.take_along_axis(unit, focus, axis=1)
        wide = np.sqrt(np.maximum(0.0, (1 - t**2)[:, None] * (1 - x**2)))
        low, high = t[:, None] * x - wide - SLACK, t[:, None] * x + wide + SLACK
        # An interval ends at the pole where the pole itself is near enough.
        low, high = np.where(-x >= t[:, None], -2.0, low), np.where(x >= t[:, None], 2.0, high)
        begin, end = np.empty(x.shape, np.int64), np.empty(x.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at], end[at] = np.searchsorted(self.sorted[:, f], low[at], side="left"), np.searchsorted(self.sorted[:, f], high[at], side="right")
        pick = np.argmin(end - begin, axis=1)
        rest = np.sqrt(np.maximum(0.0, 1 - (x**2).sum(axis=1)))
        return {int(n): (int(focus[i, j]), int(begin[i, j]), int(end[i, j]), (focus[i], x[i], rest[i], t[i])) for i, (n, j) in enumerate(zip(names, pick))}

    def candidates(self, coordinate: int, begin: int, end: int, kept: tuple, prefix: int) -> np.ndarray:
        """Rows of the interval that are long enough and whose focus coordinates leave the threshold within reach."""
        rows = self.order[begin:end, coordinate]
        rows = rows[rows < prefix]
        focus, x, rest, t = kept
        part = self.unit[rows][:, focus]
        reach = part @ x + rest * np.sqrt(np.maximum(0.0, 1 - (part**2).sum(axis=1)))
        return rows[reach >= t - SLACK]


def buckets(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> list[Bucket]:
    """Vectors by length, descending, cut where a bucket is full or too uneven."""
    order = np.argsort(-lengths, kind="stable")
    rows, ids, keys, lengths = rows[order], ids[order], keys[order], lengths[order]
    most, at, out = max(1, BUCKET_COMPONENTS // max(1, rows.shape[1])), 0, []
    while at < len(rows):
        end = min(at + most, at + max(1, int(np.searchsorted(-lengths[at:], -NARROW * lengths[at], side="right"))))
        out.append(Bucket(rows[at:end], ids[at:end], keys[at:end], lengths[at:end]))
        at = end
    return out


def unpacked(vectors, width: int) -> np.ndarray:
    """An Arrow column of lists of longs as rows of one width, ended by zeros."""
    import pyarrow as pa

    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def longs(column) -> np.ndarray:
    """Ids as numbers; null is the largest, so it loses every tie."""
    import pyarrow.compute as pc

    return pc.fill_null(column, MOST).to_numpy()


def split_by(rows: DataFrame, column: str, spread: str, size: int, name: str) -> DataFrame:
    """rows with a column `name`: classes of column by quantiles, those of more than `size` rows split by the hash of spread. Only the
    CLASSES bounds and counts go to the driver."""
    total = rows.count()
    wanted = min(CLASSES, max(1, math.ceil(total / size)))
    bounds = sorted(set(rows.approxQuantile(column, [k / wanted for k in range(1, wanted)], 0.25 / wanted))) if wanted > 1 else []
    classed = rows.withColumn(name, F.lit(0.0))
    if bounds:
        classed = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=column, outputCol=name).transform(rows)
    classed = classed.withColumn(name, F.col(name).cast("int"))
    counts = {r[name]: r["n"] for r in classed.groupBy(name).agg(F.count("*").alias("n")).collect()}
    shares = F.element_at(F.array(*(F.lit(max(1, math.ceil(counts.get(k, 0) / size))) for k in range(len(bounds) + 1))), F.col(name) + 1)
    return classed.withColumn(name, F.col(name).cast("long") * (1 << 32) + F.pmod(F.xxhash64(spread), shares))


def top_products(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k highest inner products of each query with every row but its own, ties to the smaller id.

    vectors has integer vectors (array of long); rows where the boolean expression is_query holds are the queries. Each row is a candidate.
    The search runs over length classes: a bounded set of seeds gives every query a first k-th best score; queries go in
    blocks by the length that this score asks of a vector, candidates in groups by their length, and a group is left out
    for a block that needs longer ones. In a group, buckets of nearly one length are searched from the longest, each query pruned by length or by
    coordinate, whichever its local cosine threshold makes cheaper, and what is left is verified by exact products. Pruning loses
    nothing, so the result is exact whatever the seeds.

    Null vectors and those holding a null take no part; empty ones do, with products of zero; shorter ones count as ended by zeros. Ids are longs; a null id
    loses ties. Rows of one id are rows of their own, so each asks and answers. A product beyond a long is the
    nearest long. Fewer than k other rows give as many ranks; an empty table gives none.
    """
    import pyarrow as pa

    rows = vectors.filter(F.col(vector_col).isNotNull() & ~F.exists(F.coalesce(vector_col, F.array()), lambda x: x.isNull()))
    size = F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.expr(is_query).alias("asks"), F.col(vector_col).alias("v"), F.sqrt(size).alias("length")), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    per = lambda components: max(16, components // max(1, width))

    # The longest vectors and some of all: as many components whatever the table's size.
    n_seeds = per(SEED_COMPONENTS)
    held = rows.select("key", "v", "length")
    seeds = held.orderBy(F.desc("length"), "key").limit(n_seeds // 4).unionByName(held.orderBy(F.xxhash64("key")).limit(n_seeds)).dropDuplicates(["key"]).toArrow()
    seed_rows, seed_keys, seed_lengths = unpacked(seeds.column("v"), width), seeds.column("key").to_numpy(), seeds.column("length").to_numpy()

    def first_scores(batches):
        for batch in batches:
            q, keys, lengths = unpacked(batch.column("v"), width), batch.column("key").to_numpy(), batch.column("length").to_numpy()
            least = np.full(len(q), LEAST)
            for at in range(0, len(q) if len(seed_rows) > k else 0, 256):
                score = products(q[at : at + 256], seed_rows, float(lengths[at : at + 256].max()) * float(seed_lengths.max()) * 1.0001)
                score[seed_keys[None, :] == keys[at : at + 256, None]] = LEAST
                least[at : at + 256] = np.partition(score, -k, axis=1)[:, -k]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(least > 0, least / lengths, 0.0) * (1 - SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(np.nan_to_num(need))], [*batch.schema.names, "least", "need"])

    asked = rows.filter("asks").select("key", "id", "v", "length")
    queries = stored(asked.mapInArrow(first_scores, "key long, id long, v array<long>, length double, least long, need double"), "queries")
    blocks = split_by(queries, "need", "key", per(BLOCK_COMPONENTS), "block")
    groups = split_by(rows, "length", "key", per(GROUP_COMPONENTS), "group")
    # Blocks and groups meet as two small tables of their bounds.
    reach = groups.groupBy("group").agg(F.max("length").alias("most"))
    cells = stored(blocks.groupBy("block").agg(F.min("need").alias("least_need")).join(reach, F.col("least_need") <= F.col("most")).select("block", "group"), "cells")

    def cell(asking: pa.Table, offered: pa.Table) -> pa.Table:
        q, lengths = unpacked(asking.column("v"), width), asking.column("length").to_numpy()
        best = Best(len(q), k, asking.column("least").to_numpy())
        if len(offered) and len(q):
            for bucket in buckets(unpacked(offered.column("v"), width), longs(offered.column("id")), offered.column("key").to_numpy(), offered.column("length").to_numpy()):
                bucket.search(best, q, asking.column("key").to_numpy(), lengths)
        ids = pa.array(best.id, mask=best.id == MOST)
        return pa.table({"key": asking.column("key").to_numpy()[best.query], "query_id": asking.column("id").take(pa.array(best.query)), "id": ids, "score": best.score})

    left = blocks.join(cells, "block").select("block", "group", "key", "id", "v", "length", "least")
    right = groups.join(cells, "group").select("block", "group", "key", "id", "v", "length")
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(cell, "key long, query_id long, id long, score long")
    found = stored(found, "top")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
    discard(cells)
    return ranked
