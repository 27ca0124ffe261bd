from pyspark.sql import functions as F

from graphmill.java.graph import build
from graphmill.java.scanner import scan_source
from graphmill.model import edge_faults, node_faults
from graphmill.sources import repository

SHOP = b"""package a.b;
import a.c.Base;
import java.util.*;

/** class Hidden {} */
@Deprecated
public class Cart<T extends Item> extends Base implements Runnable, Comparable<Cart> {
    private static final String MARK = "class Fake { void no() {} }";
    int one = f(), two = g();
    Cart() { this.one = 1; }
    public void run() { total(1, 2); Helper.help(); class Local { void inner() {} } }
    int total(final int x, java.util.List<String> names) { return names.size() + x; }
    int f() { return 1; }
    int g() { return 2; }
    enum Kind { A, B { void odd() {} }; Kind next() { return A; } }
    interface Item { int weight(); }
    record Point(int x, int y) { Point { check(); } void check() {} }
    @interface Mark { String value() default "x"; }
}
"""
BASE = b"package a.c;\npublic class Base { public void run() {} \n int total(int x) { return x; } }\n"
HELPER = b"package a.b;\nclass Helper { static void help() { new Cart(); } }\n"


def names(source):
    return {e["qualified_name"]: e["kind_norm"] for e in scan_source(source)["entities"]}


def test_entities_of_a_class():
    got = names(SHOP)
    assert got["a.b.Cart"] == "class" and got["a.b.Cart.Kind"] == "enum" and got["a.b.Cart.Item"] == "interface"
    assert got["a.b.Cart.Point"] == "class" and got["a.b.Cart.Mark"] == "interface"
    assert {"a.b.Cart#MARK", "a.b.Cart#one", "a.b.Cart#two"} <= {k for k, v in got.items() if v == "field"}
    methods = {k for k, v in got.items() if v == "method"}
    assert {"a.b.Cart#Cart()", "a.b.Cart#run()", "a.b.Cart#total(final,java.util.List<String>)", "a.b.Cart.Kind#next()", "a.b.Cart.Point#Point()", "a.b.Cart.Mark#value()"} <= methods
    assert "a.b.Cart#run().Local" in got and not any("Fake" in k or "Hidden" in k or "odd" in k for k in got)


def test_positions_are_one_based_bytes():
    source = "class É { int ä; }".encode()
    e = {x["qualified_name"]: {a["role"]: a for a in x["anchors"]} for x in scan_source(source)["entities"]}
    assert (e["É"]["name"]["start_col"], e["É"]["name"]["end_col"]) == (7, 9)
    assert (e["É#ä"]["definition"]["start_col"], e["É#ä"]["name"]["start_col"]) == (12, 16)


def test_broken_sources_do_not_hang():
    for source in (b"", b"class", b"class A {", b"class A { void f( }", b'"""', b"/* open", b"}}}} class B {}", b"@", b"int", b"enum E { A"):
        try:
            scan_source(source)
        except (ValueError, IndexError, KeyError):
            pass


def test_graph_of_files(spark):
    sources = [("m/src/main/java/a/b/Cart.java", SHOP), ("m/src/main/java/a/c/Base.java", BASE), ("m/src/main/java/a/b/Helper.java", HELPER), ("m/src/generated/java/a/b/Helper.java", HELPER)]
    files = spark.createDataFrame(sources, "path string, content binary").withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    files = repository.with_modules(files, spark.createDataFrame([("m", "pom.xml")], "directory string, file string"))
    nodes, edges = (x.cache() for x in build(files, "r", need_resolved=True))
    assert node_faults(nodes).collect() == [] and edge_faults(edges).collect() == []
    short = lambda x: x.rpartition("java:")[2]
    got = {(r.edge_type, r.kind, short(r.source_id), short(r.target_id)) for r in edges.filter("edge_type not in ('CONTAINS', 'HAS_ANCHOR')").collect()}
    assert ("SPECIALIZES", "extends", "a.b.Cart", "a.c.Base") in got
    assert ("DEPENDS_ON", "imports", "a.b.Cart", "a.c.Base") in got
    assert ("SPECIALIZES", "override", "a.b.Cart#run()", "a.c.Base#run()") in got
    assert ("DEPENDS_ON", "calls", "a.b.Cart#one", "a.b.Cart#f()") in got
    # Declarators share a definition, so the first owns the second's calls.
    assert ("DEPENDS_ON", "calls", "a.b.Cart#one", "a.b.Cart#g()") in got
    assert ("ALIASES", "generated-mirror", "a.b.Helper", "a.b.Helper") in got
    assert nodes.filter("node_type = 'Module'").select("name", "ecosystem", "zone").first() == ("m", "maven", "prod")
    assert edges.count() == edges.select("id").distinct().count()


def test_index_whole_and_by_changes(spark, tmp_path):
    from graphmill.plans.agent import Toolbox
    from graphmill.plans.index import index
    from graphmill.sources.store import GraphStore

    repo = tmp_path / "repo"
    for path, text in (("pom.xml", b""), ("src/main/java/a/b/Cart.java", SHOP), ("src/main/java/a/c/Base.java", BASE), ("target/Gone.java", BASE)):
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_bytes(text)
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    first = index(spark, str(repo), store, "r")
    assert (first.mode, len(first.added), first.modified) == ("full", 2, [])
    again = index(spark, str(repo), store, "r", incremental=True)
    assert (again.skipped, again.added, again.deleted_nodes, again.nodes, again.edges) == (2, [], 0, first.nodes, first.edges)
    found = Toolbox(spark, store).vector_search_seeds(["class Base a.c.Base"])["items"]
    assert found and any(x["label"] == "Base" for x in found)
    (repo / "src/main/java/a/c/Base.java").unlink()
    (repo / "src/main/java/a/b/Helper.java").write_bytes(HELPER)
    third = index(spark, str(repo), store, "r", incremental=True)
    assert (len(third.added), len(third.deleted), third.skipped) == (1, 1, 1) and third.deleted_nodes > 0
    paths = {r.path for r in store.file_hashes().collect()}
    assert paths == {"src/main/java/a/b/Cart.java", "src/main/java/a/b/Helper.java"}


def test_a_task_holds_few_files_at_once():
    import pyarrow as pa
    from graphmill.java.graph import HELD_BYTES, HELD_FILES, scanned_batches

    kind = pa.schema([("path", pa.string()), ("lines", pa.int32()), ("fault", pa.string())])
    n, long = 2 * HELD_FILES + 5, b"class A { }" + b"\n" * HELD_BYTES
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(n)], "content": pa.array([long if i == 3 else HELPER for i in range(n)], pa.binary())})
    made = list(scanned_batches([batch], kind))
    assert [p for b in made for p in b.column("path").to_pylist()] == [str(i) for i in range(n)]
    assert made[0].num_rows == 4 and max(b.num_rows for b in made) == HELD_FILES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_type_of_node_is_computed_by_itself(spark):
    """Files need no entity taken apart, and entities no anchors; nothing is looked up by a join of entities with themselves."""
    from graphmill.java import graph
    from graphmill.plans import java_corpus
    from graphmill.operators.traversal import cut

    files = cut(java_corpus.java_files(spark, "/root/testdata/sf0.001"))
    nodes, edges = graph.structure(files, cut(graph.scanned(files)), "r")
    assert "Generate" not in optimized(nodes.filter("node_type = 'File'"))
    assert optimized(nodes.filter("node_type = 'Entity'")).count("Generate") == 1
    assert optimized(edges.filter("edge_type = 'HAS_ANCHOR'")).count("Join") <= 1


def test_a_resolver_reads_stored_names(spark):
    """Its five ways each read the symbols and the names; a plan that derives them anew each time fills the driver."""
    from graphmill.java import graph
    from graphmill.operators import semantics
    from graphmill.operators.traversal import cut
    from graphmill.plans import java_corpus

    files = java_corpus.java_files(spark, "/root/testdata/sf0.001", java_corpus.RECEIVERS)
    found = cut(graph.scanned(files))
    each = cut(graph.entities(found, files, "r"))
    asked, symbols = graph.placed_uses(found, each), graph.symbols_of(each, found)
    asked_of = []

    class Recording(semantics.SymbolResolver):
        def resolve(self, candidates, symbols):
            asked_of.append(candidates)
            return super().resolve(candidates, symbols)

    graph.typed_calls(found, found, each, asked, symbols, Recording())
    assert len(asked_of) == 2 and not any("Join" in optimized(df) or "Aggregate" in optimized(df) for df in (symbols, *asked_of[:1]))


def test_uses_meet_their_owners_in_their_own_row(spark, monkeypatch):
    from graphmill.java import graph
    from graphmill.operators.traversal import cut

    files = spark.createDataFrame([("b/Cart.java", SHOP), ("c/Base.java", BASE), ("b/Helper.java", HELPER)], "path string, content binary")
    found = cut(graph.scanned(files))
    each = cut(graph.entities(found, None, "r"))
    joins, join = [], graph.intervals.innermost_owners
    monkeypatch.setattr(graph.intervals, "innermost_owners", lambda *x: joins.append(1) or join(*x))
    got = sorted(map(str, graph.placed_uses(found, each).collect()))
    assert len(got) == 20 and not joins
    # The join, which larger files take, says the same; here some files are large and some are not.
    for most in (0, 40):
        monkeypatch.setattr(graph, "MOST_IN_ROW", most)
        assert sorted(map(str, graph.placed_uses(found, each).collect())) == got
    assert len(joins) == 2


def test_only_wanted_columns_leave_the_scan(spark):
    from graphmill.java import graph

    files = spark.createDataFrame([("b/Cart.java", SHOP), ("c/Base.java", BASE), ("x/Bad.java", b"import a.B; class"), ("e/Empty.java", None)], "path string, content binary")
    wanted = ("path", "package", "imports", "wildcards")
    some = graph.scanned(files, wanted)
    assert some.columns == list(wanted)
    assert sorted(map(str, some.collect())) == sorted(map(str, graph.scanned(files).select(*wanted).collect()))
