"""A refresh that repairs inbound edges leaves what a full index would."""

import pytest

from graphmill.functions.models import EchoSummaries
from graphmill.java.scanner import scan_source
from graphmill.plans.index import index
from graphmill.sources.store import GraphStore

FILES = {
    "a/Base.java": "package a; public class Base { public int size() { return 1; } public Part part() { return new Part(); } }",
    "a/Part.java": "package a; public class Part { public int size() { return 2; } public Part next; }",
    "b/Mid.java": "package b; import a.Base; public class Mid extends Base { int only() { return part().size(); } }",
    "b/User.java": "package b; import a.*; public class User { Mid mid = new Mid(); int use(Part p) { var q = mid.part(); q.size(); p.next.size(); mid.size(); return helper(); } int helper() { return Far.far(); } }",
    "c/Far.java": "package c; public class Far { static int far() { return 3; } }",
    "c/Idle.java": "package c; public class Idle { int nothing() { return idle(); } int idle() { return 0; } }",
}
CHANGES = [
    # A member that a chain in another file ends in goes; a supertype between a receiver's type and the member's holder changes, which the
    # user's file names neither; a new class has a name that was unique.
    {
        "a/Part.java": "package a; public class Part { public Part next; }", "b/Mid.java": "package b; public class Mid extends c.Far { }", "c/Twin.java": "package c; class Twin { int helper() { return 1; } }",
        "c/Far.java": "package c; public class Far { static int far() { return 3; } int size() { return 4; } a.Part part() { return null; } }",
    },
    # The member is back with another beside it, a field has another type, a file goes, a new class hides a wildcard's.
    {
        "a/Part.java": "package a; public class Part { public int size(int n) { return 2; } public int size() { return 2; } public Other next; } class Other { int size() { return 9; } }",
        "b/Mid.java": FILES["b/Mid.java"], "c/Far.java": None, "b/Part.java": "package b; public class Part { int size() { return 5; } Part next; }",
    },
]


def written(root, files):
    for path, text in files.items():
        where = root / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.unlink(missing_ok=True) if text is None else where.write_text(text)


def said(store):
    nodes, edges = store.read()
    return {r.id for r in nodes.collect()}, {(r.id, r.kind, r.provenance, r.confidence) for r in edges.collect()}


def test_a_repaired_refresh_equals_a_full_index(spark, tmp_path):
    repo = tmp_path / "repo"
    written(repo, FILES)
    kept = GraphStore(spark, f"file://{tmp_path}/kept", buckets=2)
    index(spark, str(repo), kept, "r")
    for k, change in enumerate(CHANGES):
        written(repo, change)
        got = index(spark, str(repo), kept, "r", incremental=True, repair_inbound=True)
        assert got.n_added + got.n_modified + got.n_deleted == len(change)
        whole = GraphStore(spark, f"file://{tmp_path}/whole{k}", buckets=2)
        index(spark, str(repo), whole, "r")
        nodes, edges = said(kept)
        want_nodes, want_edges = said(whole)
        assert nodes == want_nodes and edges == want_edges, (k, nodes ^ want_nodes, edges ^ want_edges)
    keys = lambda s: {tuple(r) for r in s.uses().collect()}
    assert keys(kept) == keys(whole)


def test_a_model_is_asked_once_for_each_node(spark, tmp_path):
    folder = str(tmp_path / "asked")

    class Counting(EchoSummaries):
        def generate(self, prompts):
            import uuid

            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            return super().generate(prompts)

    written(tmp_path / "repo", {"a/Part.java": FILES["a/Part.java"]})
    (tmp_path / "asked").mkdir()
    index(spark, str(tmp_path / "repo"), GraphStore(spark, f"file://{tmp_path}/g", buckets=2), "r", text_model=Counting())
    asked = [x.read_text() for x in (tmp_path / "asked").iterdir()]
    assert len(asked) == len(set(asked)) == 5  # a module, a file, a class, a method, a field


def test_chains_and_variables_of_a_source():
    source = b"""class D extends E { X up = new X(); X parent() { return up; }
    int walk(X given, int n, String[] a, java.util.List<X> l) { X local = parent(); var v = local.parent(); var w = new q.X<String>(); for (X i : l) { i.go(); }
      v.size(1, f(2, 3)); this.side(up).size(); super.size(); new S(1).size(); size(); ((X) v).no(); "x".trim(); return 0; } }"""
    found = scan_source(source)
    assert {(v["name"], v["type"], tuple(v["init"] or ())) for v in found["variables"]} == {
        ("given", "X", ()), ("n", None, ()), ("a", None, ()), ("l", "java.util.List", ()), ("local", "X", ()), ("v", None, ("local", "parent()")), ("w", None, ("new q.X",)), ("i", "X", ()),
    }
    calls = [(c["text"], c["steps"], c["args"]) for c in found["candidates"] if c["kind"] == "calls"]
    assert calls == [
        ("parent", [], 0), ("parent", ["local"], 0), ("go", ["i"], 0), ("size", ["v"], 2), ("f", [], 2), ("side", ["this"], 1), ("size", ["this", "side()"], 0), ("size", ["super"], 0),
        ("size", ["new S"], 0), ("size", [], 0), ("no", ["?"], 0), ("trim", ["?"], 0),
    ]


@pytest.mark.parametrize("source", [b"class A { void f() { x" + b".f()" * 5000 + b"; } }", b"class A { int x = " + b",".join([b"A<B"] * 5000) + b"; }"])
def test_long_chains_and_lists_take_linear_work(source):
    import time

    began = time.perf_counter()
    scan_source(source)
    assert time.perf_counter() - began < 10


def test_deep_nesting_is_a_fault(spark):
    from graphmill.java.graph import scanned

    deep = b"class A { " * 1500 + b"}" * 1500
    rows = scanned(spark.createDataFrame([("a", deep), ("b", b"class B { }")], "path string, content binary")).collect()
    assert [(r.path, r.fault is None) for r in sorted(rows, key=lambda r: r.path)] == [("a", False), ("b", True)]
