import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.operators import retrieval, vector_index

SF = "/root/testdata/sf0.1"


def test_equal_vectors_tie_by_id_and_lengths_stay_apart(spark):
    rows = [("b", [1.0, 2.0]), ("a", [2.0, 4.0]), ("c", [1.0, 2.1]), ("zero", [0.0, 0.0]), ("long", [1.0, 2.0, 0.0]), ("none", None), *((f"k{i}", [0.3, 0.6]) for i in range(30))]
    base = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [3.0, 6.0]), (2, [0.0, 0.0, 2.0]), (3, [0.0, 0.0])], "query int, vector array<float>")
    got = [(r.query, r.id, r.rank) for r in retrieval.nearest(asked, base, 4).orderBy("query", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2), (1, "k0", 3), (1, "k1", 4), (2, "long", 1)]
    assert retrieval.nearest(asked.limit(0), base, 4).collect() == retrieval.nearest(asked, base.limit(0), 4).collect() == []


def test_index_finds_nearly_all_neighbours(spark, tmp_path, monkeypatch):
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.build_index(base, f"file://{tmp_path}/i", "vec_id", recall=0.95)
    kept = vector_index.open_index(spark, f"file://{tmp_path}/i")
    assert (kept.parts, kept.probes, kept.recall) == (index.parts, index.probes, index.recall) and np.allclose(kept.centres, index.centres)
    assert index.rows(spark).count() == base.count() and index.recall >= 0.95
    # Other queries than those the index was measured with.
    asked = base.filter("vec_id % 7 = 3").select(F.col("vec_id").alias("query"), (F.transform("embedding", lambda x: x + 0.001)).alias("vector"))
    true = {(r.query, r.id): r.score for r in retrieval.nearest(asked, base, 10, "vec_id").collect()}
    found = {(r.query, r.id): r.score for r in vector_index.search_index(kept, asked, 10).collect()}
    assert len(true.keys() & found.keys()) >= 0.9 * len(true)
    assert all(abs(true[x] - found[x]) < 1e-9 for x in true.keys() & found.keys())


def test_hot_cell_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    r = np.random.default_rng(2)
    rows = [(i, (v / 9).tolist()) for i, v in enumerate(r.normal(size=(300, 6)))] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(200)] + [(900, None), (901, [0.0] * 6), (902, [1.0])]
    base = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build_index(base, f"file://{tmp_path}/i", cells=5, k=5)
    assert max(index.parts) >= 4 and index.rows(spark).groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 120 and index.rows(spark).count() == 500
    asked = base.filter("id in (3, 310, 450)").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    whole = lambda df: sorted(map(tuple, df.collect()))
    assert whole(vector_index.search_index(index, asked, 8, probes=5)) == whole(retrieval.nearest(asked, base, 8))
    with pytest.raises(ValueError):
        vector_index.build_index(base.limit(0), f"file://{tmp_path}/j")


def test_products_are_held_in_parts():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    asked, rows = r.normal(size=(1000, 8)), r.normal(size=(10000, 8))
    top = retrieval.TopScores(pa.array(range(1000)), asked, 5)
    tracemalloc.start()
    top.add(pa.array(range(10000)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = top.rows()
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :5]
    assert got.column("id").to_pylist() == best.ravel().tolist() and peak < 40 << 20
