import random

import duckdb
import numpy as np
import pytest

from graphmill.llm import topk
from graphmill.llm.queries import OP11_SQL, op11_top_products


def brute(rows, k, asks):
    out = []
    for i, (qid, q) in enumerate(rows):
        if q is None or None in q or not asks(qid):
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), (vid is None, vid)) for j, (vid, v) in enumerate(rows) if j != i and v is not None and None not in v]
        out += [(qid, n + 1, v, -s) for n, (s, (_, v)) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(spark, rows, k):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<long>, score string")
    return sorted(map(tuple, topk.top_products(frame, "vec_id % 5 = 0", k).collect()), key=str)


@pytest.mark.parametrize("kind", ["skewed", "clustered"])
def test_pruned_search_is_exact(spark, monkeypatch, kind):
    """Small seeds, buckets and groups, so that all prunings and the classes take part."""
    for name, size in (("SEED_COMPONENTS", 900), ("BUCKET_COMPONENTS", 300), ("GROUP_COMPONENTS", 1500), ("BLOCK_COMPONENTS", 400)):
        monkeypatch.setattr(topk, name, size)
    r = np.random.default_rng(3)
    if kind == "skewed":
        x = r.normal(size=(700, 12)) * np.exp(r.normal(size=(700, 1)) * 1.5) * 20
    else:
        x = (r.normal(size=(9, 12))[r.integers(0, 9, 700)] + r.normal(size=(700, 12)) * 0.05) * 200
    x[:60] = x[0]
    rows = [(i, v) for i, v in enumerate(np.rint(x).astype(int).tolist())]
    assert got(spark, rows, 7) == brute(rows, 7, lambda i: i is not None and i % 5 == 0)


def test_both_prunings_are_chosen(monkeypatch):
    """Vectors of one length in tight clusters: high local thresholds lead to the coordinates."""
    monkeypatch.setattr(topk, "BUCKET_COMPONENTS", 16 * 500)
    r = np.random.default_rng(4)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16)) * 0.02
    x = np.rint(x / np.sqrt((x**2).sum(axis=1))[:, None] * 5000).astype(np.int64)
    lengths = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    seen = {"spans": 0}
    best = topk.Best(50, 5, np.full(50, topk.LEAST))
    for bucket in topk.buckets(x, np.arange(3000), np.arange(3000), lengths):
        plain = bucket.candidates
        bucket.candidates = lambda *a, f=plain: (seen.__setitem__("spans", seen["spans"] + 1), f(*a))[1]
        bucket.search(best, x[:50], np.arange(50), lengths[:50])
    assert seen["spans"] > 50
    scores = x[:50] @ x.T
    for q in range(50):
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        mine = best.query == q
        assert sorted(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want


def test_edges(spark):
    r = random.Random(5)
    rows = [(i, [r.randint(-3, 3) for _ in range(r.randint(0, 4))]) for i in range(30)]
    rows += [(5, None), (10, [1, None]), (None, [2, 2]), (15, [1 << 40, -(1 << 40)]), (20, [1 << 40, 1]), (20, [1 << 40, 1]), (25, [0, 0]), (30, [])]
    assert got(spark, rows, 3) == brute(rows, 3, lambda i: i is not None and i % 5 == 0)
    assert got(spark, rows[:3], 20) == brute(rows[:3], 20, lambda i: i % 5 == 0)
    assert got(spark, [(0, [1])], 3) == got(spark, [(5, None)], 3) == topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<long>"), "true").collect() == []


def test_query_equals_sql(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(400, 8)).astype(np.float32).tolist())]
    rows += [(20, rows[0][1]), (40, None), (60, [float("nan")] * 8), (80, [1.0, None]), (100, [float("inf")] * 8), (None, rows[3][1])] + [(1000 + i, rows[20][1]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_top_products(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP11_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
