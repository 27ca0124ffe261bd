"""The graph as two DataFrames: closed enums, schemas, id builders and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed enums of the data model.
NODE_TYPES = ("Repository", "Module", "File", "Entity", "Anchor", "Summary")
EDGE_TYPES = ("CONTAINS", "DEPENDS_ON", "SPECIALIZES", "ALIASES", "HAS_ANCHOR", "DESCRIBES")
VISIBLE_NODE_TYPES = ("Repository", "Module", "File", "Entity")
VISIBLE_EDGE_TYPES = ("CONTAINS", "DEPENDS_ON", "SPECIALIZES", "ALIASES")
SEMANTIC_EDGE_TYPES = ("DEPENDS_ON", "SPECIALIZES", "ALIASES")
ORIGINS = ("internal", "external", "generated")
PURPOSES = ("retrieval", "rollup")
SCHEMA_VERSION = "graphmill.graph.v1"

_TEXT = "name root_path ecosystem zone relative_path language content_hash position_encoding entity_key display_name qualified_name kind_norm kind_raw origin semantic_hash".split()

NODES = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("node_type", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.IntegerType()) for c in ("start_line", "start_col", "end_line", "end_col")]
    + [T.StructField(c, T.StringType()) for c in ("role", "text", "purpose", "source_hash", "summary_model", "embedding_model")]
    + [T.StructField("embedding_dimensions", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("ord", T.LongType())]
)
EDGES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "edge_type", "source_id", "target_id", "kind", "role", "provenance")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("ord", T.LongType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns, absent ones null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def as_nodes(df: DataFrame) -> DataFrame:
    return conform(df, NODES)


def as_edges(df: DataFrame) -> DataFrame:
    """Edges with their id built where it is absent."""
    out = conform(df, EDGES)
    return out.withColumn("id", F.coalesce("id", edge_id("edge_type", "source_id", "target_id", "kind", "role")))


def edge_id(edge_type: str, source: str, target: str, kind: str, role: str) -> Column:
    """TYPE:source:target:meaning, the meaning being the trimmed kind or else the trimmed role."""
    filled = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    return F.concat_ws(":", edge_type, source, target, F.coalesce(filled(kind), filled(role)))


def stripped(column: Column) -> Column:
    """Without white space of any sort at either end."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def blank(column: Column) -> Column:
    return column.isNull() | (stripped(column) == "")


def node_faults(nodes: DataFrame) -> DataFrame:
    """(id, fault) for each rule of the model that a node breaks."""
    required = {
        "Repository": ("name",),
        "Module": ("name", "root_path", "ecosystem", "zone"),
        "File": ("relative_path", "language", "zone", "content_hash", "position_encoding"),
        "Entity": ("entity_key", "display_name", "qualified_name", "kind_norm", "kind_raw", "origin", "semantic_hash"),
        "Anchor": ("role",),
        "Summary": ("text", "purpose", "source_hash", "summary_model", "embedding_model"),
    }
    of = lambda kind: F.col("node_type") == kind
    rules = [("blank id", blank(F.col("id"))), ("unknown node type", ~F.col("node_type").isin(*NODE_TYPES) | F.col("node_type").isNull())]
    rules += [(f"blank {c}", of(kind) & blank(F.col(c))) for kind, columns in required.items() for c in columns]
    rules.append(("unknown origin", of("Entity") & ~F.col("origin").isin(*ORIGINS)))
    placed = F.least("start_line", "start_col", "end_line", "end_col") >= 1
    whole = F.col("start_line").isNotNull() & F.col("start_col").isNotNull() & F.col("end_line").isNotNull() & F.col("end_col").isNotNull()
    rules.append(("bad position", of("Anchor") & ~F.coalesce(whole & placed & (F.struct("end_line", "end_col") >= F.struct("start_line", "start_col")), F.lit(False))))
    rules.append(("unknown purpose", of("Summary") & ~F.col("purpose").isin(*PURPOSES)))
    sound = (F.size("embedding") == F.col("embedding_dimensions")) & F.forall("embedding", lambda x: x.isNotNull())
    rules.append(("bad embedding", of("Summary") & ~F.coalesce(sound, F.lit(False))))
    return _faults(nodes, rules)


def edge_faults(edges: DataFrame) -> DataFrame:
    """(id, fault) for each rule of the model that an edge breaks."""
    rules = [("unknown edge type", ~F.col("edge_type").isin(*EDGE_TYPES) | F.col("edge_type").isNull())]
    rules += [(f"blank {c}", blank(F.col(c))) for c in ("source_id", "target_id")]
    rules.append(("neither kind nor role", blank(F.col("kind")) & blank(F.col("role"))))
    rules.append(("confidence outside 0 to 1", F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0)))
    return _faults(edges, rules)


def _faults(df: DataFrame, rules: list) -> DataFrame:
    named = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))
    return df.select("id", F.explode(named).alias("fault"))


def checked(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises on the first few rows that break the model."""
    found = node_faults(nodes).unionByName(edge_faults(edges)).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.id}: {r.fault}" for r in found))
