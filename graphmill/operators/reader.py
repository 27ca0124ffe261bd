"""Reads of a stored graph: counts, windows, one-hop expansion, lookups, prefix search, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.scalar import first_filled, sorted_json
from graphmill.model import VISIBLE_EDGE_TYPES, VISIBLE_NODE_TYPES

# The order in which kinds of nodes, entities and anchors are shown.
TYPE_ORDER = ("Repository", "Module", "File", "Entity")
KIND_ORDER = ("class", "interface", "enum", "record", "field", "method")
ROLE_ORDER = ("definition", "body", "name")
LABEL_COLUMNS = {"Repository": "name", "Module": "name", "File": "relative_path", "Entity": "display_name", "Anchor": "role", "Summary": "text"}

DIRECTIONS = ("outgoing", "incoming", "both")


def position_in(column: str, order: tuple[str, ...]) -> Column:
    """Place in a fixed order; anything else comes last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.coalesce(F.col(column), F.lit("")))
    return F.when(place == 0, len(order)).otherwise(place - 1).cast("int")


def node_label() -> Column:
    label = F.lit(None).cast("string")
    for kind, column in LABEL_COLUMNS.items():
        label = F.when(F.col("node_type") == kind, F.col(column)).otherwise(label)
    return label


def format_node(nodes: DataFrame) -> DataFrame:
    """(id, type, label, properties): the properties are the filled scalar columns as JSON with sorted keys."""
    held = [c for c in nodes.columns if c not in ("id", "node_type", "embedding", "ord")]
    pairs = F.map_from_arrays(F.array(*map(F.lit, held)), F.array(*(F.col(c).cast("string") for c in held)))
    return nodes.select("id", F.col("node_type").alias("type"), node_label().alias("label"), sorted_json(F.map_filter(pairs, lambda _, v: v.isNotNull())).alias("properties"))


def format_edge(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("type"), "kind", "role", "confidence")


def format_summary(nodes: DataFrame) -> DataFrame:
    """Summaries without their vectors."""
    return nodes.filter(F.col("node_type") == "Summary").select("id", "text", "purpose", "source_hash", "summary_model", "embedding_model", "embedding_dimensions")


def format_source_file(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") == "File").select("id", "relative_path", "language", "zone", "content_hash", "position_encoding")


def visible_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type").isin(*VISIBLE_NODE_TYPES))


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a visible type between visible nodes."""
    ids = visible_nodes(nodes).select("id")
    shown = edges.filter(F.col("edge_type").isin(*VISIBLE_EDGE_TYPES))
    return shown.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return visible_nodes(nodes).groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: visible node_count and edge_count."""
    n = visible_nodes(nodes).agg(F.count("*").alias("node_count"))
    return n.join(visible_edges(edges, nodes).agg(F.count("*").alias("edge_count")), F.lit(True))


def graph_counts(nodes: DataFrame, edges: DataFrame, resolver_provenance: str = "resolver") -> DataFrame:
    """One row: all nodes and edges, semantic edges, and those the resolver made."""
    semantic = F.col("edge_type").isin("DEPENDS_ON", "SPECIALIZES", "ALIASES")
    e = edges.agg(F.count("*").alias("edges"), F.count_if(semantic).alias("semantic_edges"), F.count_if(semantic & (F.col("provenance") == resolver_provenance)).alias("resolved_edges"))
    return nodes.agg(F.count("*").alias("nodes")).join(e, F.lit(True))


def window_order() -> list[Column]:
    return [position_in("node_type", TYPE_ORDER), position_in("kind_norm", KIND_ORDER), first_filled("relative_path", "qualified_name", "display_name", "name", "id"), F.col("id")]


def node_window(nodes: DataFrame, limit: int | None) -> DataFrame:
    ordered = visible_nodes(nodes).orderBy(*window_order())
    return ordered if limit is None else ordered.limit(limit)


def window_edges(window: DataFrame, edges: DataFrame, limit: int | None) -> DataFrame:
    """Visible edges with both ends in the window: CONTAINS first, then by source, target and id; twice the limit."""
    ids = window.select("id")
    inside = edges.filter(F.col("edge_type").isin(*VISIBLE_EDGE_TYPES))
    inside = inside.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    ordered = inside.orderBy(F.when(F.col("edge_type") == "CONTAINS", 0).otherwise(1), "source_id", "target_id", "id")
    return ordered if limit is None else ordered.limit(2 * limit)


def retrieval_summaries(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, generated_summary): the text of each node's retrieval summary, of several the one with the least id."""
    texts = nodes.filter((F.col("node_type") == "Summary") & (F.col("purpose") == "retrieval")).select(F.col("id").alias("source_id"), "text")
    described = edges.filter(F.col("edge_type") == "DESCRIBES").select("source_id", F.col("target_id").alias("id"))
    if ids is not None:
        described = described.join(ids.select("id"), "id", "left_semi")
    return described.join(texts, "source_id").groupBy("id").agg(F.min_by("text", "source_id").alias("generated_summary"))


def with_summaries(window: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return window.join(retrieval_summaries(nodes, edges, window), "id", "left")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return visible_nodes(nodes).filter(F.col("id") == node_id).limit(1)


def source_file(nodes: DataFrame, relative_path: str) -> DataFrame:
    return format_source_file(nodes).filter(F.col("relative_path") == relative_path).orderBy("id").limit(1)


def source_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """source_file() for each of many paths (relative_path) at once: the file with the least id."""
    held = format_source_file(nodes).join(paths.select("relative_path").distinct(), "relative_path", "left_semi")
    rest = [c for c in held.columns if c != "relative_path"]
    return held.groupBy("relative_path").agg(F.min_by(F.struct(*rest), "id").alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in rest), "relative_path")


def known_nodes(wanted: DataFrame, nodes: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(id, warning, open) of the wanted ids, each once: a warning for an unknown one; open are the known ones not visited."""
    asked = wanted.select("id").distinct().join(nodes.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    seen = F.lit(False)
    if visited is not None:
        asked, seen = asked.join(visited.select("id", F.lit(True).alias("seen")).distinct(), "id", "left"), F.coalesce("seen", F.lit(False))
    known = F.coalesce("known", F.lit(False))
    return asked.select("id", F.when(~known, F.concat(F.lit("unknown node: "), "id")).alias("warning"), (known & ~seen).alias("open"))


def expand(
    nodes: DataFrame, edges: DataFrame, origins: DataFrame, direction: str = "both", edge_types: tuple[str, ...] = VISIBLE_EDGE_TYPES, limit: int | None = None
) -> DataFrame:
    """One hop from each origin (a column `id`): (origin, edge_id, edge_type, kind, source_id, target_id, direction,
    neighbor, neighbor_type, neighbor_label), per origin the first `limit` by edge id.

    The edges are read once: each is put under the ends that count and meets the origins there in one equi-join. A loop
    counts once, as outgoing. An OR over the ends would plan as a nested loop. Both ends must be visible. An unknown
    direction is an error.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    kinds = [t for t in dict.fromkeys(edge_types) if t in VISIBLE_EDGE_TYPES]
    shown = edges.filter(F.col("edge_type").isin(*kinds) if kinds else F.lit(False)).select("id", "edge_type", "kind", "source_id", "target_id")
    shown_nodes = visible_nodes(nodes)
    # Origins that are not shown go before any edge moves, and an edge moves as origin and neighbour, which say its ends.
    seeds = origins.select(F.col("id").alias("origin")).distinct().join(shown_nodes.select(F.col("id").alias("origin")), "origin", "left_semi")
    # A loop leaves its origin, so it is outgoing even where only incoming edges are asked for.
    away = F.when(F.col("source_id") == F.col("origin"), "outgoing").otherwise("incoming")
    ends = {"outgoing": F.array("source_id"), "incoming": F.array("target_id"), "both": F.array_distinct(F.array("source_id", "target_id"))}[direction]
    hops = shown.withColumn("origin", F.explode(ends))
    hops = hops.withColumns({"direction": away, "neighbor": F.when(F.col("source_id") == F.col("origin"), F.col("target_id")).otherwise(F.col("source_id"))})
    hops = hops.select("id", "edge_type", "kind", "origin", "neighbor", "direction").join(seeds, "origin")
    named = shown_nodes.select(F.col("id").alias("neighbor"), F.col("node_type").alias("neighbor_type"), node_label().alias("neighbor_label"))
    hops = hops.join(named, "neighbor")
    outgoing = F.col("direction") == "outgoing"
    hops = hops.withColumns({"source_id": F.when(outgoing, F.col("origin")).otherwise(F.col("neighbor")), "target_id": F.when(outgoing, F.col("neighbor")).otherwise(F.col("origin"))})
    if limit is not None:
        hops = hops.withColumn("place", F.row_number().over(Window.partitionBy("origin").orderBy("id"))).filter(F.col("place") <= limit).drop("place")
    return hops.select("origin", F.col("id").alias("edge_id"), "edge_type", "kind", "source_id", "target_id", "direction", "neighbor", "neighbor_type", "neighbor_label")


def neighbors(nodes: DataFrame, edges: DataFrame, origins: DataFrame, direction: str = "both", edge_types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Distinct neighbours over all origins, the limit counting per origin; no edge types means all visible ones."""
    hops = expand(nodes, edges, origins, direction, edge_types or VISIBLE_EDGE_TYPES, limit)
    return hops.select(F.col("neighbor").alias("id"), F.col("neighbor_type").alias("type"), F.col("neighbor_label").alias("label")).distinct()


def anchors_of(nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, id, role, positions) of the owners' anchors, the role being the edge's; definition, body, name, others."""
    held = edges.filter(F.col("edge_type") == "HAS_ANCHOR").select(F.col("source_id").alias("owner"), F.col("target_id").alias("id"), "role")
    held = held.join(owners.select(F.col("id").alias("owner")).distinct(), "owner", "left_semi")
    places = nodes.filter(F.col("node_type") == "Anchor").select("id", "start_line", "start_col", "end_line", "end_col")
    return held.join(places, "id").select("owner", "id", "role", "start_line", "start_col", "end_line", "end_col").orderBy("owner", position_in("role", ROLE_ORDER), "start_line", "id")


#: The columns that a prefix search looks into.
SEARCHED = ("name", "display_name", "qualified_name", "relative_path")


def search_order() -> Column:
    return F.coalesce("display_name", "qualified_name", "relative_path", "name", "id")


def auto_complete(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Visible nodes with a name, display name, qualified name or path that starts with the query, case aside."""
    wanted = query.strip().lower()
    if not wanted:
        return nodes.limit(0).select("id", F.col("node_type").alias("type"), F.lit("").alias("label"))
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | F.startswith(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted))
    return visible_nodes(nodes).filter(hit).orderBy(search_order(), "id").limit(limit).select("id", F.col("node_type").alias("type"), node_label().alias("label"))
