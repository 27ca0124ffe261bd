"""What the stored graph writes and opens."""

import random
from pathlib import Path

import pytest

from graphmill.model import as_edges, as_nodes
from graphmill.operators import reader
from graphmill.sources import store as stores
from graphmill.sources.store import GraphStore


def nodes_of(spark, rows):
    return as_nodes(spark.createDataFrame(rows, "id string, node_type string, display_name string, text string"))


def edges_of(spark, rows):
    return as_edges(spark.createDataFrame(rows, "edge_type string, source_id string, target_id string, kind string"))


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


@pytest.fixture
def large(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=16)
    ids = spark.range(4000).selectExpr("concat('n', id) AS id", "'Entity' AS node_type", "concat('name ', id) AS display_name")
    links = spark.range(4000).selectExpr("'DEPENDS_ON' AS edge_type", "concat('n', id) AS source_id", "concat('n', (id * 7) % 4000) AS target_id", "'calls' AS kind")
    store.overwrite(as_nodes(ids), as_edges(links))
    return store


def test_a_small_change_writes_little(spark, large, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_CHANGES", 2)
    root = f"{tmp_path}/g"
    base = size(root)
    for k in range(2):
        version = large.upsert(nodes_of(spark, [("n5", "Entity", f"new {k}", None), (f"m{k}", "Entity", "m", "t")]), edges_of(spark, [("DEPENDS_ON", f"m{k}", "n5", "calls"), ("DEPENDS_ON", "m0", "nowhere", "calls")]))
        assert size(f"{root}/v{version}") < base / 10
    # The third change merges the two before it into the buckets that they touch, and no others.
    before = large.pointer()
    version = large.upsert(nodes_of(spark, [("n6", "Entity", None, "t")]), edges_of(spark, []))
    after = large.pointer()
    assert after["changes"] == [version] and after["version"] == before["version"] + 1
    moved = {name: sum(v == version for v in after[name].values()) for name in stores.TABLES}
    assert 0 < moved["nodes"] <= 3 and 0 < moved["sources"] <= 2 and 0 < moved["targets"] <= 1
    nodes, edges = large.read()
    found = {r.id: (r.display_name, r.text) for r in nodes.filter("id in ('n5', 'n6', 'm0', 'm1')").collect()}
    assert found == {"n5": ("new 1", None), "n6": ("name 6", "t"), "m0": ("m", "t"), "m1": ("m", "t")}
    assert nodes.count() == 4002 and edges.count() == 4002
    held = lambda: (sorted(map(str, large.read()[0].collect())), sorted(map(str, large.read()[1].collect())))
    same = held()
    large.compact()
    assert held() == same and large.pointer()["changes"] == []


def test_expansion_opens_few_files(spark, large):
    ids = spark.createDataFrame([("n7",)], "id string")
    whole_nodes, whole_edges = large.read()
    large.upsert(nodes_of(spark, [("x", "Entity", "x", None)]), edges_of(spark, [("DEPENDS_ON", "x", "n7", "calls"), ("DEPENDS_ON", "n7", "n7", "calls")]))
    nodes, edges = large.around(ids)
    rows = lambda hops: sorted(map(str, hops.select("edge_id", "direction", "neighbor", "neighbor_label").collect()))
    assert rows(reader.expand(nodes, edges, ids)) == rows(reader.expand(*large.read(), ids)) and len(rows(reader.expand(nodes, edges, ids))) == 4
    opened = lambda df: {f for f in df.inputFiles() if "/change/" not in f}
    assert len(opened(nodes)) <= len(opened(whole_nodes)) / 3
    for name in ("sources", "targets"):
        buckets = large._buckets_of(large.pointer(), ids)
        assert len(buckets) == 1 and len(opened(large._table(large.pointer(), name, buckets))) == 1
    assert [r.id for r in large.nodes_of(ids).collect()] == ["n7"] and len(opened(large.nodes_of(ids))) == 1
    for direction in ("outgoing", "incoming"):
        assert rows(reader.expand(*large.around(ids, direction), ids, direction)) == rows(reader.expand(*large.read(), ids, direction))


def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    """Random upserts and removals against plain dictionaries, through several merges into the base."""
    monkeypatch.setattr(stores, "MOST_CHANGES", 2)
    store, r = GraphStore(spark, f"file://{tmp_path}/g", buckets=3), random.Random(3)
    nodes, edges = {}, set()
    for step in range(6):
        gone = {x for x in nodes if r.random() < 0.2}
        nodes = {k: v for k, v in nodes.items() if k not in gone}
        edges = {e for e in edges if not gone & set(e)}
        new = {f"n{r.randrange(12)}": (r.choice(["a", "b", None]), r.choice(["t", None])) for _ in range(4)}
        for k, v in new.items():
            nodes[k] = tuple(y if y is not None else x for x, y in zip(nodes.get(k, (None, None)), v))
        links = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(4)}
        lost = {e for e in edges if r.random() < 0.1}
        edges = (edges - lost) | {e for e in links if set(e) <= nodes.keys()}
        rows = nodes_of(spark, [(k, "Entity", *v) for k, v in new.items()])
        held = store.read()[1]
        removed = stores.edges_at(held, spark.createDataFrame([(x,) for x in gone], "id string")).unionByName(held.filter(held.id.isin([f"DEPENDS_ON:{a}:{b}:calls" for a, b in lost])).select("id", "source_id", "target_id"))
        store.change(rows, edges_of(spark, [("DEPENDS_ON", a, b, "calls") for a, b in links]), spark.createDataFrame([(x,) for x in gone], "id string"), removed)
        found = store.read()
        assert {x.id: (x.display_name, x.text) for x in found[0].collect()} == nodes, step
        assert {(x.source_id, x.target_id) for x in found[1].collect()} == edges, step
        other = store._table(store.pointer(), "targets")
        assert {(x.source_id, x.target_id) for x in other.collect()} == edges


def test_edges_with_open_ends_are_found_without_moving_the_others(spark):
    from graphmill.model import as_edges
    from graphmill.sources.store import with_both_ends, without_open_ends

    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("a", "b"), ("b", "b"), ("a", "x"), ("y", "b"), (None, "a"), ("a", None)]
    edges = as_edges(spark.createDataFrame([(s, t, "CALLS", "k") for s, t in rows], "source_id string, target_id string, edge_type string, kind string"))
    ends = lambda df: sorted((r.source_id, r.target_id) for r in df.collect())
    assert ends(without_open_ends(edges, ids)) == ends(with_both_ends(edges, ids)) == [("a", "b"), ("b", "b")]
    whole = without_open_ends(edges.filter("source_id in ('a', 'b') and target_id = 'b'"), ids)
    assert len(whole.collect()) == 2 and "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_a_graph_is_stored_without_a_copy_beside_its_tables(spark, tmp_path, monkeypatch):
    """Open ends are found as edges are placed: nothing is cut, a task writes one bucket, and both copies lack such edges."""
    monkeypatch.setattr(stores, "cut", lambda df: pytest.fail("edges were stored beside the tables"))
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=7)
    nodes = nodes_of(spark, [(f"n{k}", "Entity", None, None) for k in range(60)] + [("n0", "Entity", "again", None)])
    rows = [("DEPENDS_ON", f"n{k}", f"n{k * 7 % 60}", "calls") for k in range(60)]
    opened = [("DEPENDS_ON", "n1", "x", "calls"), ("DEPENDS_ON", "y", "n2", "calls"), ("DEPENDS_ON", None, "n3", "calls"), ("DEPENDS_ON", "n4", None, "calls")]
    for given in (rows, rows + opened, opened[1:3], opened, []):
        store.overwrite(nodes, edges_of(spark, given))
        at = store.pointer()
        for name in ("sources", "targets"):
            found = sorted((r.edge_type, r.source_id, r.target_id, r.kind) for r in store._table(at, name).collect())
            assert found == (sorted(rows) if rows[0] in given else []), name
            assert all(len(list(Path(f"{tmp_path}/g/v{v}/{name}/bucket={k}").rglob("*.parquet"))) == 1 for k, v in at[name].items())
    store.write(nodes, edges_of(spark, rows + opened))
    assert store.read()[1].count() == len(rows + opened)


def test_a_base_of_an_older_placement_keeps_it(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=5)
    nodes = nodes_of(spark, [(f"n{k}", "Entity", f"name {k}", None) for k in range(40)])
    edges = edges_of(spark, [("DEPENDS_ON", f"n{k}", f"n{k * 7 % 40}", "calls") for k in range(40)])
    old = {"version": 1, "buckets": 5, "changes": []}
    store._publish(old | {name: store._write_buckets(old, 1, name, rows) for name, rows in (("nodes", nodes), ("sources", edges), ("targets", edges))})
    store.upsert(nodes_of(spark, [("n3", "Entity", "new", None)]), edges_of(spark, []))
    store.compact()
    assert "hash" not in store.pointer()
    ids = spark.createDataFrame([(f"n{k}",) for k in range(40)], "id string")
    for k in (3, 4, 17):
        one = ids.filter(f"id = 'n{k}'")
        assert [r.display_name for r in store.nodes_of(one).collect()] == ["new" if k == 3 else f"name {k}"]
        assert store.around(one)[1].count() == (2 if k * 7 % 40 != k else 1)
