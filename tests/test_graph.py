import json

import duckdb
import pytest
from graphmill import cli
from graphmill.config import default_config
from graphmill.functions.models import HashedEmbeddings, checked_vectors
from graphmill.model import as_edges, as_nodes, checked, edge_faults, node_faults
from graphmill.operators import merge, reader, retrieval, traversal
from graphmill.plans import catalog
from graphmill.plans.agent import Conversation, Toolbox, edge_types_of
from graphmill.sources import repository
from graphmill.sources.store import GraphStore
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "A3_A9_targets A11_read_slice E3_expand_graph E10_H5_nearest E11_innermost_time E16_aliases E19_I2_file_changes I7_keep_first J1_trails K_one_line D1_D3_visible_nodes D12_D13_known_ids E17_last_anchor E25_utf16_column "
    "C1_C7_C10_C11_code_nodes C6_C8_C9_code_edges C13_C14_candidates C15_request_faults E11_H9_owner_of_use E12_location_targets E13_E14_semantic_edges F12_resolver_counts L2_L3_L4_L7_summaries"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    quoted = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want))) and want


def test_closure_stores_deep_levels_and_ends_on_loops(spark):
    step = spark.createDataFrame([*((str(i), str(i + 1)) for i in range(7)), ("7", "2")], "id string, next string")
    found = traversal._closure(spark.createDataFrame([("0",)], "id string"), step, levels_a_plan=2).collect()
    assert sorted((r.id, r.depth) for r in found) == [(str(i), i) for i in range(8)]


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def nodes_of(spark, rows):
    return as_nodes(spark.createDataFrame(rows, "id string, node_type string, display_name string, relative_path string, qualified_name string"))


def edges_of(spark, rows):
    return as_edges(spark.createDataFrame(rows, "edge_type string, source_id string, target_id string, kind string"))


@pytest.fixture
def small(spark):
    nodes = nodes_of(spark, [("f", "File", None, "a/F.java", None), ("a", "Entity", "A", None, "p.A"), ("b", "Entity", "B", None, "p.B"), ("c", "Entity", "50%_c", None, "q.C"), ("x", "Anchor", None, None, None)])
    edges = edges_of(spark, [("CONTAINS", "f", "a", "m"), ("DEPENDS_ON", "a", "b", "calls"), ("DEPENDS_ON", "a", "a", "calls"), ("SPECIALIZES", "c", "a", "extends"), ("HAS_ANCHOR", "a", "x", "body"), ("DEPENDS_ON", "a", "b", "type-use")])
    return nodes, edges


def test_expand_directions_and_loops(spark, small):
    at = lambda d, **k: sorted((r.edge_id, r.direction, r.neighbor) for r in reader.expand(*small, catalog.ids(spark, "a"), d, **k).collect())
    loop = ("DEPENDS_ON:a:a:calls", "outgoing", "a")
    out = [loop, ("DEPENDS_ON:a:b:calls", "outgoing", "b"), ("DEPENDS_ON:a:b:type-use", "outgoing", "b")]
    into = [("CONTAINS:f:a:m", "incoming", "f"), ("SPECIALIZES:c:a:extends", "incoming", "c")]
    assert at("outgoing") == out and at("both") == sorted(out + into) and at("incoming") == sorted([loop, *into])
    assert at("both", limit=2) == sorted(out + into)[:2] and at("both", edge_types=()) == []
    with pytest.raises(ValueError):
        reader.expand(*small, catalog.ids(spark, "a"), "sideways")


def test_prefix_is_literal(spark, small):
    found = lambda q: [r.id for r in reader.auto_complete(small[0], q, 5).collect()]
    assert found("50%_") == ["c"] and found("5_") == [] and found("P.") == ["a", "b"] and found(" ") == []


def test_trails_repeat_no_edge(spark):
    edges = edges_of(spark, [("DEPENDS_ON", "a", "b", "k"), ("DEPENDS_ON", "b", "a", "k"), ("DEPENDS_ON", "b", "c", "k")])
    got = [r.path for r in traversal.trails(edges, catalog.ids(spark, "a"), catalog.ids(spark, "c", "a"), 4).orderBy("depth", "path").collect()]
    assert got == ["a>b>a", "a>b>c"]
    ends = catalog.ids(spark, "a"), catalog.ids(spark, "c", "a")
    for limit in (1, 2, 3):
        whole = [tuple(r) for r in traversal.trails(edges, *ends, 4).orderBy("depth", "path", "edge_ids").collect()]
        assert sorted(map(tuple, traversal.trails(edges, *ends, 4, limit).collect()), key=lambda r: r[2:]) == whole[:limit]
    with pytest.raises(ValueError):
        traversal.trails(edges, catalog.ids(spark, "a"), catalog.ids(spark, "c"), 0)


def test_model_faults(spark, small):
    bad = nodes_of(spark, [(" ", "Thing", None, None, None)])
    assert {r.fault for r in node_faults(bad).collect()} == {"blank id", "unknown node type"}
    wrong = as_edges(spark.createDataFrame([("CONTAINS", "a", " ", " ", 2.0)], "edge_type string, source_id string, target_id string, kind string, confidence double"))
    assert {r.fault for r in edge_faults(wrong).collect()} == {"blank target_id", "neither kind nor role", "confidence outside 0 to 1"}
    with pytest.raises(ValueError):
        checked(bad, wrong)


def test_store_merges_and_deletes(spark, small, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert not store.exists() and store.read()[0].count() == 0
    nodes, edges = small
    store.overwrite(nodes, edges.unionByName(edges_of(spark, [("DEPENDS_ON", "a", "gone", "calls")])))
    first = {t: sorted(map(str, df.collect())) for t, df in zip("ne", store.read())}
    assert store.read()[1].count() == 6
    store.upsert(nodes, edges)
    assert {t: sorted(map(str, df.collect())) for t, df in zip("ne", store.read())} == first
    store.upsert(nodes_of(spark, [("a", "Entity", "New", None, None)]), edges.limit(0))
    a = store.read()[0].filter("id = 'a'").first()
    assert (a.display_name, a.qualified_name) == ("New", "p.A")
    assert store.delete_files(["a/F.java", "none"]) == 3 and store.delete_files(["none"]) == 0
    left, held = store.read()
    assert {r.id for r in left.collect()} == {"b", "c"} and held.count() == 0


def test_a_refresh_is_one_version(spark, small, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    nodes, edges = small
    store.overwrite(nodes, edges)
    version = store.pointer()["version"]
    assert store.refresh(["a/F.java"], nodes_of(spark, [("f", "File", None, "a/F.java", None), ("n", "Entity", "N", None, "p.N")]), edges_of(spark, [("CONTAINS", "f", "n", "m"), ("SPECIALIZES", "n", "b", "extends")])) == 3
    assert store.pointer()["version"] == version + 1
    left, held = store.read()
    assert {r.id for r in left.collect()} == {"f", "n", "b", "c"} and {r.id for r in held.collect()} == {"CONTAINS:f:n:m", "SPECIALIZES:n:b:extends"}


def test_a_document_is_never_without_a_version(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    for i in range(5):
        store.write_text("state", f'{{"n": {i}}}')
    assert store.read_text("state") == '{"n": 4}' and len(store._versions("state")) == 2
    # A writer that dies before its rename leaves the version before it.
    monkeypatch.setattr(store, "_path", lambda name, own=store._path: (_ for _ in ()).throw(OSError()) if name.startswith("_state") else own(name))
    with pytest.raises(OSError):
        store.write_text("state", "{}")
    assert store.read_text("state") == '{"n": 4}' and store.read_text("none") is None


def test_vectors_of_two_lengths_are_refused(spark, tmp_path):
    nodes = as_nodes(spark.createDataFrame([("s", "Summary", [1.0]), ("t", "Summary", [1.0, 2.0])], "id string, node_type string, embedding array<float>"))
    with pytest.raises(ValueError):
        GraphStore(spark, f"file://{tmp_path}/g").write(nodes, edges_of(spark, []).limit(0))


def test_candidates_and_rerank(spark):
    hits = spark.createDataFrame([(0, "s-a", 0.75, 1), (0, "s-b", 0.55, 2), (1, "s-a2", 0.90, 1), (1, "s-c", 0.65, 2)], "query int, id string, score double, rank int")
    rows = [("node-a", "Entity", "a", None), ("node-b", "Entity", "b", None), ("node-c", "Entity", "c", None), *((s, "Summary", None, s) for s in ("s-a", "s-b", "s-a2", "s-c"))]
    nodes = as_nodes(spark.createDataFrame(rows, "id string, node_type string, display_name string, text string").withColumn("purpose", F.lit("retrieval")))
    edges = edges_of(spark, [("DESCRIBES", "s-a", "node-a", "r"), ("DESCRIBES", "s-a2", "node-a", "r"), ("DESCRIBES", "s-b", "node-b", "r"), ("DESCRIBES", "s-c", "node-c", "r")])
    found = retrieval.seed_candidates(hits, nodes, edges).cache()
    assert [(r.id, r.text) for r in found.orderBy("index").collect()] == [("node-a", "s-a2"), ("node-b", "s-b"), ("node-c", "s-c")]
    got = retrieval.rerank(found, "q", lambda q, d, n: [(2, 0.91), (0, 0.72), (1, 0.51), (9, 1.0)], 5).collect()
    assert [r.id for r in got] == ["node-c", "node-a", "node-b"] and abs(got[1].vector_score - 0.9) < 1e-9
    filled = retrieval.rerank(found, "q", lambda q, d, n: [(1, -3.0)], 2).collect()
    assert [r.id for r in filled] == ["node-a", "node-b"]


def test_nearest_takes_any_number_of_queries(spark, monkeypatch):
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = base.filter("vec_id < 40").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, retrieval.nearest(asked, base, 3, "vec_id").collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 15)
    assert sorted(map(tuple, retrieval.nearest(asked, base, 3, "vec_id").collect())) == want and len(want) == 120


def test_ignore_rules(spark):
    paths = ["a/B.java", "target/X.java", "build/generated/X.java", "build/node_modules/generated/X.java", ".git/x", "Out/generated-sources/Y.java", "src/outs/Z.java"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(repository.is_ignored(F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [False, True, False, True, True, False, False]


def test_paths_stay_inside(tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    assert repository.read_slice(str(tmp_path), "./a.txt", 2, 9, 1) == {"relative_path": "a.txt", "start_line": 2, "end_line": 2, "text": "2", "truncated": True, "total_lines": 3}
    for wrong in ("../x", "/etc/passwd", "."):
        with pytest.raises(ValueError):
            repository.normalize_relative_path(str(tmp_path), wrong)


def test_vector_checks():
    assert HashedEmbeddings(8).embed(["a b"])[0] == HashedEmbeddings(8).embed(["a b"])[0]
    assert checked_vectors([[1, 2], [3, 4]], 2, 2).tolist() == [[1.0, 2.0], [3.0, 4.0]] and checked_vectors([[1.5]], 1, None).tolist() == [[1.5]]
    with pytest.raises(ValueError):
        checked_vectors([[1.0, 2.0], [3.0]], 2, None)
    for bad in ([[1.0], [2.0]], [[True]], [[1.0, 2.0]], [["x"]], [[None]], [], [1.0]):
        with pytest.raises(ValueError):
            checked_vectors(bad, 1, 1)


def test_edge_type_arguments():
    assert edge_types_of(None)[0] == ["CONTAINS", "DEPENDS_ON", "SPECIALIZES", "ALIASES"]
    assert edge_types_of(["HAS_ANCHOR", "CONTAINS", "CONTAINS"]) == (["CONTAINS"], ["edge type not available: HAS_ANCHOR"]) and edge_types_of([])[0] == []


def test_agent_limits(spark, small, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.overwrite(*small)
    box = Toolbox(spark, store, known={"a"})
    turns = []

    def plan(question, evidence):
        turns.append(len(evidence))
        return [{"name": "expand_neighbors", "args": {"node_ids": ["a" if not evidence else "b", "zzz"]}}, {"function": {"name": "nothing", "arguments": "{}"}}]

    reply = Conversation(box, plan, lambda q, e: f"{q}:{len(e)}").ask([{"role": "user", "content": " why "}])
    used = [t for t in reply["traces"] if t["tool"] == "expand_neighbors"]
    assert len(used) == 3 and {i["neighbor"] for i in used[0]["items"]} == {"a", "b", "c", "f"} and used[0]["warnings"] == ["unknown node: zzz"]
    assert used[2]["items"] == [] and reply["message"]["content"].startswith("why:")
    with pytest.raises(ValueError):
        Conversation(box, plan, str).ask([{"role": "assistant", "content": "x"}])


def test_command_line(tmp_path, capsys):
    assert cli.main(["init", str(tmp_path)]) == 0
    assert json.loads((tmp_path / ".graphmill/config.json").read_text()) == default_config()
    with pytest.raises(SystemExit) as stop:
        cli.main(["tools", "vector-search-seeds", "--query", ""])
    assert stop.value.code == 2
    for wrong in (["expand-neighbors", "--node-id", "a", "--direction", "sideways"], ["query-relation", "--node-id", "a", "--relation-type", "HAS_ANCHOR"]):
        assert cli.main(["tools", *wrong, "--repository", str(tmp_path)]) == 1
    (tmp_path / ".graphmill/config.json").write_text("{}")
    capsys.readouterr()
    assert cli.main(["tools", "query-relation", "--node-id", "a", "--relation-type", "CONTAINS", "--repository", str(tmp_path)]) == 1
    assert capsys.readouterr().out == ""


def test_trails_keep_only_edges_between_sources_and_targets(spark):
    """Edges that no source reaches, or that reach no target in the edges that are left, are gone before the walk."""
    pairs = [("s", "a"), ("a", "t"), ("a", "b"), ("b", "c"), ("c", "t"), ("x", "t"), ("t", "y"), ("s", "t"), ("b", "a")]
    edges = spark.createDataFrame([(f"{a}{b}", a, b) for a, b in pairs], "id string, source_id string, target_id string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    kept = edges.join(traversal.useful_pairs(edges, one("s"), one("t").withColumnRenamed("id", "target_id"), 3), (F.xxhash64("source_id") == F.col("a")) & (F.xxhash64("target_id") == F.col("b")))
    assert sorted((r.id, r.left) for r in kept.collect()) == [("at", 0), ("sa", 1), ("st", 0)]
    assert sorted(r.path for r in traversal.trails(edges, one("s"), one("t"), 4).collect()) == ["s>a>b>a>t", "s>a>b>c>t", "s>a>t", "s>t"]


def test_expanding_moves_an_edge_as_origin_and_neighbour(spark):
    from graphmill.model import as_edges, as_nodes
    from graphmill.operators import reader

    nodes = as_nodes(spark.createDataFrame([("a", "File"), ("b", "File"), ("h", "Anchor")], "id string, node_type string"))
    ends = [("1", "a", "b"), ("2", "b", "a"), ("3", "a", "a"), ("4", "h", "a"), ("5", "b", "h")]
    edges = as_edges(spark.createDataFrame([(*e, "CONTAINS", "k") for e in ends], "id string, source_id string, target_id string, edge_type string, kind string"))
    seeds = spark.createDataFrame([("a",), ("h",)], "id string")
    got = {way: sorted((r.edge_id[-1:], r.source_id, r.target_id, r.direction, r.neighbor) for r in reader.expand(nodes, edges, seeds, way).collect()) for way in reader.DIRECTIONS}
    out, back, loop = ("a", "b", "outgoing", "b"), ("b", "a", "incoming", "b"), ("a", "a", "outgoing", "a")
    assert {k: sorted(x[1:] for x in v) for k, v in got.items()} == {"outgoing": sorted([out, loop]), "incoming": sorted([back, loop]), "both": sorted([out, back, loop])}

    def joined(plan):
        if plan.nodeName() == "Join":
            yield plan.output().toString()
        for i in range(plan.children().size()):
            yield from joined(plan.children().apply(i))

    found = list(joined(reader.neighbors(nodes, edges, seeds, limit=5)._jdf.queryExecution().optimizedPlan()))
    assert found and not any("source_id" in x or "target_id" in x for x in found)
