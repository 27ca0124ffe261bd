"""Closures by interval labels against closures level by level."""

import random

from graphmill.model import as_edges, as_nodes
from graphmill.operators import labels, traversal
from graphmill.sources.store import GraphStore


def held(spark, pairs):
    return as_edges(spark.createDataFrame([("CONTAINS", a, b, "m") for a, b in pairs], "edge_type string, source_id string, target_id string, kind string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def brute_labels(pairs):
    """{id: (root, first, last, depth)} by plain recursion over children in order."""
    children, above, out = {}, {}, {}
    for a, b in pairs:
        children.setdefault(a, []).append(b)
        above[b] = a

    def visit(node, root, number, depth):
        first = number
        for child in sorted(children.get(node, [])):
            number = visit(child, root, number + 1, depth + 1)
        out[node] = (root, first, number, depth)
        return number

    for root in children.keys() - above.keys():
        visit(root, root, 0, 0)
    return out


def test_random_forests(spark):
    r = random.Random(11)
    # A chain, a parent of many children, and bushes.
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(20)] + [("hub", f"h{k}") for k in range(300)] + [("top", "hub")]
    pairs += [(f"b{r.randrange(max(0, k - 9), k)}", f"b{k}") for k in range(3, 120)]
    edges = held(spark, pairs + pairs[:5])
    found = labels.forest_labels(edges)
    assert {x.id: (x.root, x.first, x.last, x.depth) for x in found.collect()} == brute_labels(pairs)
    seeds = spark.createDataFrame([(x,) for x in ("c0", "c9", "c20", "hub", "top", "h7", "b0", "b4", "b50", "unknown", "hub", None)], "id string")
    known = seeds.filter("id is not null")
    assert rows(labels.descendants(found, seeds)) == rows(traversal.descendants(edges, known))
    kinds = {"c": "File", "h": "Entity", "t": "Repository", "b": "Module", "u": "File"}
    nodes = as_nodes(spark.createDataFrame([(x, kinds[x[0]]) for x in {y for p in pairs for y in p} | {"unknown"}], "id string, node_type string"))
    assert rows(labels.ancestors(nodes, found, seeds)) == rows(traversal.ancestors(nodes, edges, known))
    assert rows(labels.source_files_of(nodes, found, seeds)) == rows(traversal.source_files_of(nodes, edges, known))


def test_no_forest(spark):
    tree = [("a", "b"), ("b", "c")]
    assert labels.forest_labels(held(spark, [*tree, ("x", "c")])) is None
    assert labels.forest_labels(held(spark, [*tree, ("l", "m"), ("m", "n"), ("n", "l")])) is None
    assert labels.forest_labels(held(spark, [*tree, ("s", "s")])) is None
    empty = labels.forest_labels(held(spark, []))
    assert empty.count() == 0 and rows(labels.descendants(empty, spark.createDataFrame([("q",)], "id string"))) == [("q", "q", 0)]


def test_labels_stay_with_the_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=2)
    nodes = as_nodes(spark.createDataFrame([("r", "Repository"), ("f", "File"), ("e", "Entity")], "id string, node_type string"))
    store.overwrite(nodes, held(spark, [("r", "f"), ("f", "e")]))
    seeds = spark.createDataFrame([("f",), ("e",)], "id string")
    closures = lambda: [rows(store.descendants(seeds)), rows(store.ancestors(seeds)), rows(store.source_files_of(seeds))]
    before = closures()
    assert store.label_forest() and store.pointer()["labels"] and closures() == before
    assert before == [[("e", "e", 0), ("f", "e", 1), ("f", "f", 0)], [("e", "f", 1), ("e", "r", 2), ("f", "f", 0), ("f", "r", 1)], [("e", "f"), ("f", "f")]]
    # Nodes alone leave the labels; containment makes them go, and the levels answer.
    store.upsert(nodes.limit(1), held(spark, []))
    assert store.pointer()["labels"] and closures() == before
    store.upsert(as_nodes(spark.createDataFrame([("g", "Entity")], "id string, node_type string")), held(spark, [("e", "g"), ("g", "f")]))
    assert "labels" not in store.pointer() and ("e", "g", 1) in closures()[0]
    assert not store.label_forest()


def test_a_bushy_forest_is_ranked_without_doubling(spark, monkeypatch):
    """Leaves are taken off while they are half of the nodes, so that nothing is left to double; a chain is left to it whole."""
    doubled, core = [], labels.core_labels
    monkeypatch.setattr(labels, "core_labels", lambda children, weights: doubled.append(children.count()) or core(children, weights))
    bushy = [("r", f"m{i}") for i in range(3)] + [(f"m{i}", f"f{i}{k}") for i in range(3) for k in range(4)] + [("f00", f"e{k}") for k in range(30)] + [("q", "m9")]
    chain = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    for pairs, left in ((bushy, 0), (chain, 9)):
        got = {x.id: (x.root, x.first, x.last, x.depth) for x in labels.forest_labels(held(spark, pairs)).collect()}
        assert got == brute_labels(pairs) and doubled.pop() == left
