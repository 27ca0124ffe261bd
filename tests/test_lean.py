"""What is stored and moved on the way, beside the same results: closures, lineages, shuffles and uses."""

import time

from pyspark.sql import functions as F

from graphmill.java import graph
from graphmill.operators import maintenance, receivers, semantics, traversal

JAVA = {
    "p/A.java": "package p; public class A { void run() { run(); } void run(int x) { } }",
    "p/B.java": "package p; import java.util.*; class B extends A implements I { void run() { super.run(); A a = new A(); } }",
    "p/I.java": "package p; interface I { void run(); }",
}


def test_types_that_are_all_moved_are_met_once(spark, monkeypatch):
    """A line of types that all have moved needs no level more for each type above another."""
    types = [(f"p{k}", f"t{k}") for k in range(9)]
    uses = spark.createDataFrame([(p, "name", "size") for p, _ in types] + [("far", "type", "t8")], "path string, sort string, key string")
    supers = spark.createDataFrame([(f"t{k + 1}", f"t{k}") for k in range(8)], "child string, parent string")
    stored, cut = [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: stored.append(1) or cut(df))
    found = maintenance.touched_files(uses, spark.createDataFrame([("p0",)], "path string"), spark.createDataFrame([("size",)], "key string"), spark.createDataFrame(types, "path string, type string"), supers)
    assert {r.path for r in found.collect()} == {p for p, _ in types[1:]} | {"far"}
    assert len(stored) <= 2


def test_a_pair_of_a_lineage_is_stored_once(spark, monkeypatch):
    types = spark.createDataFrame([(k,) for k in range(20)], "id long")
    # A line of 18 types, a shortcut in it, and a loop of two.
    supers = spark.createDataFrame([(k + 1, k) for k in range(17)] + [(9, 2), (18, 19), (19, 18)], "child long, parent long")
    stored, cut = [], receivers.cut

    def counted(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(receivers, "cut", counted)
    got = {(r.type, r.holder): r.up for r in receivers.lineages(types, supers).collect()}
    step, want = {}, {}
    for r in supers.collect():
        step.setdefault(r.child, set()).add(r.parent)
    for k in range(20):
        front, depth = {k}, 0
        while front:
            want |= {(k, x): depth for x in front}
            front, depth = {y for x in front for y in step.get(x, ())} - {b for a, b in want if a == k}, depth + 1
    assert got == want
    assert sum(x.count() for x in stored) == len(want)


def test_a_cut_leaves_no_shuffle(spark):
    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")

    before = held()
    found = traversal.cut(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and found.count() == 997


def test_supertypes_are_those_of_the_whole_graph(spark):
    rows = [(p, bytearray(t.encode()), p, ".", "maven", "root", "prod", "prod", ".") for p, t in JAVA.items()]
    files = spark.createDataFrame(rows, "path string, content binary, content_hash string, module_root string, module_ecosystem string, module_name string, file_zone string, module_zone string, source_root string")
    found = traversal.cut(graph.scanned(files))
    nodes, edges = graph.structure(files, found, "r")
    named = graph.semantic_edges(found, files, "r")[0]
    own, up = graph.supertype_edges(found, "r")
    assert sorted(map(str, up.collect())) == sorted(map(str, named.filter("edge_type = 'SPECIALIZES'").collect())) and up.count() == 2
    columns = ["id", "qualified_name", "kind_norm"]
    assert sorted(map(str, own.select(*columns).collect())) == sorted(map(str, nodes.filter("node_type = 'Entity'").select(*columns).collect()))
    got = semantics.override_edges(own, up).select("source_id", "target_id")
    assert sorted(got.collect()) == sorted(semantics.override_edges(nodes, edges.unionByName(named)).select("source_id", "target_id").collect())
