from graphmill.model import NODES, as_edges, as_nodes
from graphmill.sources.store import GraphStore
from graphmill.streaming.changes import file_change_stream
from graphmill.streaming.refresh import merge_stream


def test_a_stream_is_merged_once(spark, tmp_path):
    source, store = f"{tmp_path}/in", GraphStore(spark, f"file://{tmp_path}/g")
    rows = lambda *r: as_nodes(spark.createDataFrame(r, "id string, node_type string, display_name string"))
    linked = lambda batch: as_edges(batch.filter("id != 'a'").selectExpr("'DEPENDS_ON' AS edge_type", "id AS source_id", "'a' AS target_id", "'calls' AS kind"))
    run = lambda: merge_stream(spark.readStream.schema(NODES).parquet(source), store, linked, f"{tmp_path}/c").awaitTermination()
    rows(("a", "Entity", "A"), ("b", "Entity", "B")).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(("b", "Entity", "New"), ("c", "Entity", "C")).coalesce(1).write.mode("append").parquet(source)
    run()
    version = store.pointer()["version"]
    run()
    nodes, edges = store.read()
    assert {r.id: r.display_name for r in nodes.collect()} == {"a": "A", "b": "New", "c": "C"}
    assert {r.source_id for r in edges.collect()} == {"b", "c"} and store.pointer()["version"] == version


def test_versions_become_changes_across_runs(spark, tmp_path):
    schema = "path string, version long, content_hash string"
    runs = [
        ([("a", 1, "x"), ("b", 2, "y"), ("b", 1, "x"), ("c", 1, None), ("d", 1, "q"), (None, 1, "x"), ("e", None, "x")], [("a", 1, "added"), ("b", 1, "added"), ("b", 2, "modified"), ("d", 1, "added")]),
        # Late and repeated versions, an unchanged one, a deletion and what comes late after it.
        ([("b", 1, "z"), ("a", 1, "x"), ("a", 2, "x"), ("d", 3, None), ("d", 2, "w"), ("c", 2, "n")], [("c", 2, "added"), ("d", 2, "modified"), ("d", 3, "deleted")]),
        ([("d", 2, "late"), ("d", 4, "q"), ("a", 3, None)], [("a", 3, "deleted"), ("d", 4, "added")]),
    ]
    before = set()
    for rows, want in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changed = file_change_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        changed.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet", outputMode="append").awaitTermination()
        got = {tuple(r) for r in spark.read.schema(changed.schema).parquet(f"{tmp_path}/out").collect()}
        assert sorted(got - before) == want and before <= got
        before = got


def test_a_path_makes_no_table_where_nothing_changes():
    """A path whose versions are late or repeated gives no output and leaves its state as it is."""
    import pandas as pd

    class Held:
        exists, get, updates = True, (3, "x"), 0

        def update(self, value):
            self.get, self.updates = value, self.updates + 1

    class Grouped:
        def groupBy(self, *_):
            return self

        filter = select = groupBy

        def applyInPandasWithState(self, step, *_):
            return step

    step, state = file_change_stream(Grouped()), Held()
    late = pd.DataFrame({"version": [2, 1], "content_hash": ["a", None]})
    assert list(step(("p",), iter([late]), state)) == [] and state.updates == 0
    new = pd.DataFrame({"version": [5, 4], "content_hash": [None, "x"]})
    assert [tuple(r) for out in step(("p",), iter([new, late]), state) for r in out.itertuples(index=False)] == [("p", 5, "deleted")]
    assert state.get == (5, None)
