"""Set operations and merges over graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.model import SEMANTIC_EDGE_TYPES
from graphmill.operators.traversal import ancestors, descendants


def keep_first(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row per key, the first by `order`. A grouped minimum over whole rows: it combines before the shuffle, so a key
    with many rows is no hot task."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest, order), F.struct(F.col(order).isNull(), F.col(order))).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in df.columns if c != key)).select(*df.columns)


def union_keep_first(parts: list[DataFrame]) -> DataFrame:
    """The union of graph tables; of rows with one id the earlier table's stays, and within a table the first by ord. A
    grouped minimum, which combines before the shuffle."""
    rest = [c for c in parts[0].columns if c != "id"]
    stacked = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    best = stacked.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("part", F.col("ord").isNull(), "ord")).alias("row"))
    return best.select(*(F.col("id") if c == "id" else F.col(f"row.{c}").alias(c) for c in parts[0].columns))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Property-level upsert: a filled property of the new row wins, one it lacks keeps its old value."""
    columns = [c for c in old.columns if c != "id"]
    joined = old.alias("o").join(new.alias("n"), "id", "full_outer")
    return joined.select("id", *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns))


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge upsert by id. A new edge without both ends in nodes is left out, silently."""
    ids = nodes.select("id")
    placed = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return merge_nodes(old, placed.select(*old.columns))


def file_subgraph_ids(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of the files, all they contain, and those nodes' anchors and summaries."""
    held = descendants(edges, files).select("id").distinct()
    anchors = edges.filter(F.col("edge_type") == "HAS_ANCHOR").join(held.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    summaries = edges.filter(F.col("edge_type") == "DESCRIBES").join(held.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return held.unionByName(anchors).unionByName(summaries).distinct().join(nodes.select("id"), "id", "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes, and without edges at either end of them."""
    gone = ids.select("id")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def incremental_ids(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Ids that a refresh of the changed files writes: the files' ancestors and descendants, and the anchors of both."""
    files = nodes.filter(F.col("node_type") == "File").join(changed_paths, "relative_path", "left_semi").select("id")
    held = descendants(edges, files).select("id").unionByName(ancestors(nodes, edges, files).select("id")).distinct()
    anchors = edges.filter(F.col("edge_type") == "HAS_ANCHOR").join(held.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return held.unionByName(anchors).distinct()


def select_incremental(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The selected nodes; edges with both ends selected, and semantic edges that touch a selected file or entity."""
    kept = nodes.join(ids.select("id"), "id", "left_semi")
    own = kept.filter(F.col("node_type").isin("File", "Entity")).select("id")
    chosen = ids.select("id")
    inside = edges.join(chosen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(chosen.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    semantic = edges.filter(F.col("edge_type").isin(*SEMANTIC_EDGE_TYPES))
    touching = [semantic.join(own.withColumnRenamed("id", c), c, "left_semi") for c in ("source_id", "target_id")]
    return kept, reduce(DataFrame.unionByName, (x.select(*edges.columns) for x in (inside, *touching))).dropDuplicates(["id"])


def grouped_list(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n, items): each key's items as a sorted list. A list is one row, so it has to fit a task."""
    return rows.groupBy(key).agg(F.count(item).alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def file_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status): added, modified, deleted or unchanged, from two tables of path and content_hash."""
    joined = current.select("path", F.col("content_hash").alias("now")).join(previous.select("path", F.col("content_hash").alias("then")), "path", "full_outer")
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted", "unchanged")))


def dimension_check(nodes: DataFrame) -> DataFrame:
    """One row: the number of different embedding lengths; a graph may have one at most."""
    return nodes.filter("embedding is not null").agg(F.count_distinct(F.size("embedding")).alias("dimension_count"))


def stale_summaries(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Retrieval summaries of the targets whose own current summary is not among `targets` with current = true."""
    stale = targets.filter(~F.col("current")).select("id")
    described = edges.filter(F.col("edge_type") == "DESCRIBES").join(stale.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    own = nodes.filter((F.col("node_type") == "Summary") & (F.col("purpose") == "retrieval")).select("id")
    return described.select(F.col("source_id").alias("id")).distinct().join(own, "id", "left_semi")
