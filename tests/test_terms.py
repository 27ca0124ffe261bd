"""Prefix search over sorted terms against a search of all nodes."""

import random

from graphmill.model import as_edges, as_nodes
from graphmill.operators import reader, term_index
from graphmill.sources import store as stores
from graphmill.sources.store import GraphStore

COLUMNS = "id string, node_type string, name string, display_name string, qualified_name string, relative_path string"


def no_edges(spark):
    return as_edges(spark.createDataFrame([], "edge_type string, source_id string, target_id string, kind string"))


def test_a_prefix_opens_few_files(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=16)
    ids = spark.range(4000).selectExpr("concat('n', id) AS id", "'Entity' AS node_type", "concat('Name ', lpad(id, 5, '0')) AS display_name", "'same' AS name")
    store.overwrite(as_nodes(ids), no_edges(spark))
    before = store.auto_complete("name 001", 500).collect()
    store.index_terms()
    assert store.auto_complete("name 001", 500).collect() == before and len(before) == 100
    where = store._terms_at(store.pointer()["terms"][0])
    files = lambda p: len(term_index.with_prefix(spark, where, p).inputFiles())
    # Half of the rows lie under one term, which fills several files.
    assert files("name 001") <= 2 and files("name 00123") == 1 and files("same") >= 6 and files("zzz") == files("a") == 0
    assert store.auto_complete("SAME", 3).count() == 3 and store.auto_complete("zzz", 3).count() == 0 and store.auto_complete("  ", 3).count() == 0


def test_changes_equal_a_search_of_all_nodes(spark, tmp_path, monkeypatch):
    """Random upserts, removals, merges of layers and a rebuild; nulls, ties and other scripts."""
    monkeypatch.setattr(stores, "MOST_CHANGES", 2)
    store, r = GraphStore(spark, f"file://{tmp_path}/g", buckets=3), random.Random(5)
    word = lambda: r.choice([None, "", *("".join(r.choice("abABé中\U0001f600.") for _ in range(r.randrange(1, 4))) for _ in range(4))])
    row = lambda k: (f"n{k}", r.choice(["Entity", "File", "Summary"]), word(), word(), word(), word())
    nodes = lambda rows: as_nodes(spark.createDataFrame(rows, COLUMNS))

    def same():
        for q in r.sample(("a", "B", "é", "中", "\U0001f600", "ab", ".a"), 2):
            assert store.auto_complete(q, 7).collect() == reader.auto_complete(store.read()[0], q, 7).collect(), q

    store.overwrite(nodes([row(k) for k in range(40)]), no_edges(spark))
    store.index_terms()
    same()
    kept = []
    for step in range(5):
        gone = spark.createDataFrame([(f"n{r.randrange(44)}",) for _ in range(3)], "id string")
        store.change(nodes([row(k) for k in r.sample(range(44), 2)]), no_edges(spark), gone)
        kept.append(len(store.pointer()["terms"]))
        same()
    assert max(kept) == 3 and min(kept) < 3
    store.compact()
    assert len(store.pointer()["terms"]) == 1
    same()
    store.overwrite(nodes([row(k) for k in range(9)]), no_edges(spark))
    assert store.pointer()["terms"] == [store.pointer()["version"]]
    same()
    store.overwrite(nodes([]), no_edges(spark))
    assert store.auto_complete("a", 7).collect() == []


def test_small_layers_merge_beside_a_large_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_CHANGES", 2)
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=2)
    store.overwrite(as_nodes(spark.range(200).selectExpr("concat('n', id) AS id", "'Entity' AS node_type", "concat('x', id) AS name")), no_edges(spark))
    base = store.index_terms()
    for k in range(3):
        store.upsert(as_nodes(spark.createDataFrame([(f"n{k}", "Entity", f"y{k}", None, None, None), ("n9", "Entity", f"z{k}", None, None, None)], COLUMNS)), no_edges(spark))
    assert store.pointer()["terms"] == [base, store.pointer()["version"]]
    assert [x.id for x in store.auto_complete("y", 9).collect()] == ["n0", "n1", "n2"]
    assert [x.id for x in store.auto_complete("z", 9).collect()] == [x.id for x in store.auto_complete("z2", 9).collect()] == ["n9"]
    assert store.auto_complete("x", 500).count() == 196


def test_a_change_folds_only_the_nodes_that_it_touches(spark, tmp_path, monkeypatch):
    """Their terms are computed once, from rows that are touched, before they are sorted by range."""
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=2)
    nodes = lambda rows: as_nodes(spark.createDataFrame(rows, COLUMNS))
    store.overwrite(nodes([(f"n{k}", "Entity", f"x{k}", None, None, None) for k in range(50)]), no_edges(spark))
    store.index_terms()
    plans, write = [], term_index.write_terms
    monkeypatch.setattr(term_index, "write_terms", lambda rows, *more: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, *more)))
    store.change(nodes([("n1", "Entity", None, "y", "X1", None), ("m", "File", "x1", None, None, None)]), no_edges(spark), spark.createDataFrame([("n2",)], "id string"))
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]
    where = store._terms_at(store.pointer()["version"])
    assert sorted((r.term, r.id) for r in spark.read.parquet(f"{where}/terms").collect()) == [("x1", "m"), ("x1", "n1"), ("y", "n1")]
    assert [r.id for r in store.auto_complete("x1", 99).collect() if r.id in ("m", "n1")] == ["m", "n1"] and store.auto_complete("x2", 99).filter("id = 'n2'").isEmpty()
