import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphmill.llm.exact_dedup import exact_dedup
from graphmill.llm.simhash import build_tree, cells_of, fingerprint_of, leaf_links, near_duplicates, route, with_fingerprints

SCHEMA = "doc_id long, text string, kept string, rid int"


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is not None, x), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_dedup_edges(spark):
    long = "äb" * 40000
    texts = ["", None, "a", "a", "ab", "a" * 24, "a" * 24, "a" * 25, long, long, long + "x", long + "y", "x" * 900 + "p", "x" * 900 + "q", "x" * 900 + "p"]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)] + [(3, "a", "clash", 0), (None, "a", None, None), (None, None, None, None)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_print(text, k=3):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def test_fingerprint():
    for text in ["", " \n", "one", "Two wordS", "a b c", "ä É b c d e f e f e f", "x " * 5000]:
        assert fingerprint_of(text.encode(), 3) == brute_print(text)


def brute_components(prints):
    ids = sorted(prints, key=str)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(prints[x] ^ prints[y]).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def clustered(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        x = r.choice(out)
        for _ in range(r.randint(0, 3)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def test_tree_loses_no_link():
    values = np.array(clustered(3000, 1), np.uint64)
    tree = build_tree(values[:500], 5, 2)
    pairs = set()
    for _, part in route(values, tree, 2):
        a, b = leaf_links(part, 2)
        pairs |= set(zip(a.tolist(), b.tolist()))
    root = {int(v): int(v) for v in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        assert bin(a ^ b).count("1") > 0
        x, y = sorted((find(a), find(b)))
        root[y] = x
    unique = np.unique(values)
    near = np.bitwise_count(unique[:, None] ^ unique[None, :]) <= 2
    for x, y in zip(*np.nonzero(near)):
        assert find(int(unique[x])) == find(int(unique[y]))


def test_components_match_brute_force(spark):
    prints = dict(enumerate(clustered(400, 2)))
    signed = [(k, int(np.uint64(v).view(np.int64))) for k, v in prints.items()]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_components(prints)


def test_large_leaves_are_split_without_loss(spark):
    r = random.Random(8)
    centre = r.getrandbits(64)
    # A ball that no vantage point cuts, and points that can be cut.
    ball = {centre}
    while len(ball) < 500:
        ball.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    prints = dict(enumerate([*ball, *clustered(700, 9)]))
    frame = spark.createDataFrame([(k, int(np.uint64(v).view(np.int64)), "x") for k, v in prints.items()], "doc_id long, fp long, component_id string")
    got = near_duplicates(frame, leaf_most=60)
    assert got.columns.count("component_id") == 1 and {r.doc_id: r.component_id for r in got.collect()} == brute_components(prints)
    sizes = [x["count"] for x in cells_of(frame.select("fp").distinct(), [], 2, 60)[0].groupBy("leaf", "low", "high").count().collect()]
    assert max(sizes) < 100 and len(sizes) > 30


def test_fingerprints_of_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "A b C d", "y"), (None, "A b C d", "y")]
    got = with_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, extra string"), "text").collect()
    assert [(r.doc_id, r.fp) for r in got[:2]] == [(1, 0), (2, 0)]
    assert got[2].fp == int(np.uint64(brute_print("A b C d")).view(np.int64)) == got[3].fp
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(with_fingerprints(empty, "text")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_small_tables_take_few_files_however_many_partitions(spark, monkeypatch):
    from graphmill.llm import components, storage

    made = []

    def counted(*args):
        out = storage.stored(*args)
        made.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
        got = {r.node: r.root for r in components.connected(chain, "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(1, 61)}
    assert len(made) > 3 and max(made[1:]) <= spark.sparkContext.defaultParallelism
