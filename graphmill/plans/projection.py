"""Graphs projected from the star-schema and corpus tables, for running the operators on data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.scalar import prefixed_sha256
from graphmill.model import as_edges, as_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str, anchors: bool = False) -> DataFrame:
    """Region to repository, nation to module, customers and suppliers to files, orders and parts to entities, lines to anchors."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").select("n_nationkey", "n_name")
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey")
    owners = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", "n_name", "c_name").alias("owner"))
    parts = [
        t("region").select(_id("repo:r", "r_regionkey").alias("id"), F.lit("Repository").alias("node_type"), F.col("r_name").alias("name")),
        nations.select(_id("module:n", "n_nationkey").alias("id"), F.lit("Module").alias("node_type"), F.col("n_name").alias("name")),
        customers.select(_id("file:c", "c_custkey").alias("id"), F.lit("File").alias("node_type"), F.col("c_name").alias("relative_path")),
        t("supplier").select(_id("file:s", "s_suppkey").alias("id"), F.lit("File").alias("node_type"), F.col("s_name").alias("relative_path")),
        t("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            _id("entity:o", "o_orderkey").alias("id"), F.lit("Entity").alias("node_type"), _id("order#", "o_orderkey").alias("display_name"),
            F.concat("owner", F.lit("#o"), F.col("o_orderkey").cast("string")).alias("qualified_name"), F.col("o_orderpriority").alias("kind_norm"),
        ),
        t("part").select(_id("entity:p", "p_partkey").alias("id"), F.lit("Entity").alias("node_type"), F.col("p_name").alias("display_name"), F.lit("class").alias("kind_norm")),
    ]
    if anchors:
        parts.append(line_anchors(spark, sf_dir).select(F.col("anchor").alias("id"), F.lit("Anchor").alias("node_type"), F.lit("body").alias("role"), *(F.lit(1).alias(c) if c.endswith("col") else F.col("l_linenumber").alias(c) for c in ("start_line", "start_col", "end_line", "end_col"))))
    out = as_nodes(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_nodes(p))
    return out


def line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor, l_orderkey, l_linenumber): order and line number repeat, so the id carries three more columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return lines.select(F.concat_ws(":", F.lit("anchor"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "at").alias("anchor"), "l_orderkey", "l_linenumber")


def star_edges(spark: SparkSession, sf_dir: str, anchors: bool = False) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    held = lambda df, a, b: df.select(F.lit("CONTAINS").alias("edge_type"), a.alias("source_id"), b.alias("target_id"), F.lit("physical-membership").alias("kind"))
    kind = F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "type-use").otherwise("references")
    first = t("part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    parts = [
        held(t("nation"), _id("repo:r", "n_regionkey"), _id("module:n", "n_nationkey")),
        held(t("customer"), _id("module:n", "c_nationkey"), _id("file:c", "c_custkey")),
        held(t("supplier"), _id("module:n", "s_nationkey"), _id("file:s", "s_suppkey")),
        held(t("orders"), _id("file:c", "o_custkey"), _id("entity:o", "o_orderkey")),
        t("lineitem").select("l_orderkey", "l_partkey", kind.alias("kind")).distinct().select(F.lit("DEPENDS_ON").alias("edge_type"), _id("entity:o", "l_orderkey").alias("source_id"), _id("entity:p", "l_partkey").alias("target_id"), "kind"),
        t("part").select("p_partkey", "p_brand").join(first, "p_brand").filter("p_partkey != first").select(F.lit("SPECIALIZES").alias("edge_type"), _id("entity:p", "p_partkey").alias("source_id"), _id("entity:p", "first").alias("target_id"), F.lit("extends").alias("kind")),
    ]
    if anchors:
        parts.append(line_anchors(spark, sf_dir).select(F.lit("HAS_ANCHOR").alias("edge_type"), _id("entity:o", "l_orderkey").alias("source_id"), F.col("anchor").alias("target_id"), F.lit("body").alias("role")))
    out = as_edges(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_edges(p))
    return out


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages to repositories, sources to modules, documents to files, embeddings to summaries."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings")
    parts = [
        docs.select(F.concat(F.lit("repo:"), "lang").alias("id"), F.lit("Repository").alias("node_type"), F.col("lang").alias("name")).distinct(),
        docs.select(F.concat_ws(":", F.lit("module"), "lang", "source").alias("id"), F.lit("Module").alias("node_type"), F.col("source").alias("name")).distinct(),
        docs.select(_id("file:d", "doc_id").alias("id"), F.lit("File").alias("node_type"), F.concat_ws("/", "lang", "source", "doc_id").alias("relative_path"), F.lit("text").alias("language"), prefixed_sha256(F.col("text")).alias("content_hash")),
        vectors.select(
            _id("summary:v", "vec_id").alias("id"), F.lit("Summary").alias("node_type"), _id("summary ", "vec_id").alias("text"), F.lit("retrieval").alias("purpose"), F.lit("local").alias("embedding_model"),
            F.size("embedding").alias("embedding_dimensions"), F.col("embedding"),
        ),
    ]
    out = as_nodes(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_nodes(p))
    return out


def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id")
    held = lambda df, a, b: df.select(F.lit("CONTAINS").alias("edge_type"), a.alias("source_id"), b.alias("target_id"), F.lit("physical-membership").alias("kind"))
    module = F.concat_ws(":", F.lit("module"), "lang", "source")
    parts = [
        held(docs.select("lang", "source").distinct(), F.concat(F.lit("repo:"), "lang"), module),
        held(docs, module, _id("file:d", "doc_id")),
        vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select(F.lit("DESCRIBES").alias("edge_type"), _id("summary:v", "vec_id").alias("source_id"), _id("file:d", "doc_id").alias("target_id"), F.lit("retrieval").alias("kind")),
    ]
    out = as_edges(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_edges(p))
    return out


STAR_SQL = """
star_nodes AS (
  SELECT 'repo:r' || r_regionkey AS id, 'Repository' AS node_type, r_name AS name, NULL AS relative_path, NULL AS display_name, NULL AS qualified_name, NULL AS kind_norm FROM region
  UNION ALL SELECT 'module:n' || n_nationkey, 'Module', n_name, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'file:c' || c_custkey, 'File', NULL, c_name, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'file:s' || s_suppkey, 'File', NULL, s_name, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'entity:o' || o_orderkey, 'Entity', NULL, NULL, 'order#' || o_orderkey, n_name || '.' || c_name || '#o' || o_orderkey, o_orderpriority
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'entity:p' || p_partkey, 'Entity', NULL, NULL, p_name, NULL, 'class' FROM part),
star_raw AS (
  SELECT 'CONTAINS' AS edge_type, 'repo:r' || n_regionkey AS source_id, 'module:n' || n_nationkey AS target_id, 'physical-membership' AS kind FROM nation
  UNION ALL SELECT 'CONTAINS', 'module:n' || c_nationkey, 'file:c' || c_custkey, 'physical-membership' FROM customer
  UNION ALL SELECT 'CONTAINS', 'module:n' || s_nationkey, 'file:s' || s_suppkey, 'physical-membership' FROM supplier
  UNION ALL SELECT 'CONTAINS', 'file:c' || o_custkey, 'entity:o' || o_orderkey, 'physical-membership' FROM orders
  UNION ALL SELECT DISTINCT 'DEPENDS_ON', 'entity:o' || l_orderkey, 'entity:p' || l_partkey, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'type-use' ELSE 'references' END FROM lineitem
  UNION ALL SELECT 'SPECIALIZES', 'entity:p' || p_partkey, 'entity:p' || min(p_partkey) OVER (PARTITION BY p_brand), 'extends' FROM part QUALIFY p_partkey <> min(p_partkey) OVER (PARTITION BY p_brand)),
star_edges AS (SELECT edge_type || ':' || source_id || ':' || target_id || ':' || kind AS id, * FROM star_raw),
star_anchors AS (
  SELECT 'anchor:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || epoch_us(l_shipdate) AS anchor, 'entity:o' || l_orderkey AS owner, l_linenumber FROM lineitem)"""
