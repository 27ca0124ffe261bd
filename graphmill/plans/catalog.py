"""Registry of the engine's queries and the SQL each one is compared with. Keys start with the operator's id."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import scalar
from graphmill.functions.models import EchoSummaries, HashedEmbeddings, OverlapReranker
from graphmill.operators import intervals, labels, merge, reader, retrieval, semantics, summaries, traversal, vector_index
from graphmill.plans import java_corpus
from graphmill.plans.projection import STAR_SQL, corpus_edges, corpus_nodes, line_anchors, star_edges, star_nodes, table
from graphmill.sources import repository, store
from graphmill.sources.shared import shared_folder
from graphmill.streaming import changes

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, star: bool = False):
    """Registers a query under its function's name, and its SQL; star puts the projected graph before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {STAR_SQL}{sql}" if star else sql
        return f

    return add


def star(spark: SparkSession, sf: str, anchors: bool = False) -> tuple[DataFrame, DataFrame]:
    return star_nodes(spark, sf, anchors), star_edges(spark, sf, anchors)


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return corpus_nodes(spark, sf), corpus_edges(spark, sf)


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


LABEL_SQL = "CASE node_type WHEN 'File' THEN relative_path WHEN 'Entity' THEN display_name ELSE name END"

# ---- scans -----------------------------------------------------------------------------------------------------------

PATH_OF_PAGE = "regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@query(f"SELECT page_id, len(list_intersect(string_split(lower({PATH_OF_PAGE}), '/'), ['build','dist','out','target','node_modules','de'])) > 0 AND NOT (len(list_intersect(string_split(lower({PATH_OF_PAGE}), '/'), ['dist','node_modules','de'])) = 0 AND list_has_any(string_split(lower({PATH_OF_PAGE}), '/'), ['generated','generated-sources'])) AS ignored FROM (SELECT page_id, replace(url, '/de/', '/build/') AS url FROM pages)")
def A2_ignored_path(spark, sf):
    path = F.regexp_extract(F.replace("url", F.lit("/de/"), F.lit("/build/")), "^[^:]*://([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", repository.is_ignored(path).alias("ignored"))


@query("""WITH f AS (SELECT doc_id, lang || '/' || source || '/' || CASE doc_id % 5 WHEN 0 THEN 'src/main/java/' WHEN 1 THEN 'src/test/java/' WHEN 2 THEN 'tools/' WHEN 3 THEN 'vendor/' ELSE 'generated-sources/' END || doc_id || '.java' AS path FROM documents),
m AS (SELECT DISTINCT lang || '/' || source AS directory, lang = 'en' AS maven FROM documents WHERE source IN ('src0', 'src1', 'src2') UNION ALL SELECT DISTINCT lang, lang <> 'de' FROM documents WHERE lang <> 'es'),
b AS (SELECT doc_id, path, max_by(directory, length(directory)) AS d, max_by(maven, length(directory)) AS maven FROM f LEFT JOIN m ON starts_with(path, directory || '/') GROUP BY ALL)
SELECT doc_id, coalesce(d, '.') AS module_root, CASE WHEN coalesce(maven, true) THEN 'maven' ELSE 'gradle' END AS module_ecosystem, coalesce(replace(d, '/', ':'), 'root') AS module_name,
CASE doc_id % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'test' WHEN 2 THEN 'tooling' WHEN 3 THEN 'vendor' ELSE 'generated' END AS file_zone,
CASE doc_id % 5 WHEN 2 THEN 'tooling' WHEN 3 THEN 'vendor' ELSE 'prod' END AS module_zone,
CASE WHEN d IS NULL OR NOT contains(d, '/') THEN '.' WHEN doc_id % 5 = 0 THEN 'src/main/java' WHEN doc_id % 5 = 1 THEN 'src/test/java' WHEN doc_id % 5 = 4 THEN 'generated-sources' ELSE '.' END AS source_root FROM b""")
def A3_A9_targets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    at = F.element_at(F.array(*map(F.lit, ("src/main/java/", "src/test/java/", "tools/", "vendor/", "generated-sources/"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = docs.select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), at, F.col("doc_id").cast("string"), F.lit(".java")).alias("path"))
    inner = docs.filter(F.col("source").isin("src0", "src1", "src2")).select(F.concat_ws("/", "lang", "source").alias("directory"), F.when(F.col("lang") == "en", "pom.xml").otherwise("build.gradle").alias("file"))
    outer = docs.filter("lang != 'es'").select(F.col("lang").alias("directory"), F.when(F.col("lang") != "de", "pom.xml").otherwise("settings.gradle").alias("file"))
    return repository.with_modules(files, inner.unionByName(outer).distinct()).drop("path")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def A10_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalar.prefixed_sha256(F.col("text")).alias("content_hash"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS total FROM documents)
SELECT doc_id, CASE WHEN total >= 2 THEN array_to_string(lines[2:least(9, total, 4)], chr(10)) END AS slice, CASE WHEN total >= 2 THEN least(9, total, 4) < least(9, total) END AS truncated, CAST(total AS BIGINT) AS total_lines FROM l""")
def A11_read_slice(spark, sf):
    out = repository.line_slice(table(spark, sf, "documents"), "text", F.lit(2), F.lit(9), max_lines=3)
    return out.select("doc_id", "slice", "truncated", F.col("total_lines").cast("long").alias("total_lines"))


@query(f" SELECT id, node_type, {LABEL_SQL} AS label FROM star_nodes WHERE node_type = 'File'", star=True)
def A15_label_scan(spark, sf):
    nodes = star_nodes(spark, sf)
    return nodes.filter("node_type = 'File'").select("id", "node_type", reader.node_label().alias("label"))


@query("SELECT lang || '/' || source || '/' || doc_id AS path, 'sha256:' || sha256(text) AS content_hash FROM documents")
def A16_file_hashes(spark, sf):
    return store.file_hashes(corpus_nodes(spark, sf), "text")


@query("SELECT 'Summary' AS label, 'embedding' AS property, CAST(max(len(embedding)) AS BIGINT) AS dimension, count(*) AS vectors FROM embeddings")
def A17_vector_catalog(spark, sf):
    return store.vector_catalog(corpus_nodes(spark, sf))


# ---- merges and deletes ----------------------------------------------------------------------------------------------

CHANGED_FILES = "SELECT 'file:c' || c_custkey AS id, 'File' AS node_type, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' END AS relative_path, 'fr' AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'file:x' || s_suppkey, 'File', s_name, NULL FROM supplier"


def changed_files(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 3 = 0").selectExpr("concat('file:c', c_custkey) AS id", "'File' AS node_type", "CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '!') END AS relative_path", "'fr' AS name")
    return merge.keep_first(reader_nodes(c.unionByName(table(spark, sf, "supplier").selectExpr("concat('file:x', s_suppkey) AS id", "'File' AS node_type", "s_name AS relative_path", "CAST(NULL AS STRING) AS name"))))


def reader_nodes(df):
    from graphmill.model import as_nodes

    return as_nodes(df)


def stored(spark, sf):
    """The star graph in a store of its own."""
    held = store.GraphStore(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    held.overwrite(*star(spark, sf))
    return held


@query(f", new AS ({CHANGED_FILES}), down AS (SELECT 'file:c' || c_custkey AS id FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'entity:o' || o_orderkey FROM orders WHERE o_custkey % 7 = 0) SELECT id, coalesce(n.node_type, o.node_type) AS node_type, coalesce(n.name, o.name) AS name, coalesce(n.relative_path, o.relative_path) AS relative_path, o.display_name FROM (SELECT * FROM star_nodes WHERE id NOT IN (SELECT id FROM down)) o FULL JOIN new n USING (id)", star=True)
def A18_B1_B4_B6_stored_nodes(spark, sf):
    """A stored graph that loses every seventh customer's file and gets the changed files, as two changes beside its base."""
    held = stored(spark, sf)
    held.delete_files(table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.col("c_name").alias("path")))
    held.upsert(changed_files(spark, sf), star_edges(spark, sf).limit(0))
    return held.read()[0].select("id", "node_type", "name", "relative_path", "display_name")


@query(f", new AS ({CHANGED_FILES}) SELECT id, coalesce(n.node_type, o.node_type) AS node_type, coalesce(n.name, o.name) AS name, coalesce(n.relative_path, o.relative_path) AS relative_path, o.display_name FROM star_nodes o FULL JOIN new n USING (id)", star=True)
def B2_upsert_nodes(spark, sf):
    return merge.merge_nodes(star_nodes(spark, sf), changed_files(spark, sf)).select("id", "node_type", "name", "relative_path", "display_name")


@query(""" SELECT id, edge_type, source_id, target_id, kind FROM star_edges UNION ALL
SELECT 'ALIASES:file:c' || c_custkey || ':file:s' || c_custkey || ':twin', 'ALIASES', 'file:c' || c_custkey, 'file:s' || c_custkey, 'twin' FROM customer JOIN supplier ON s_suppkey = c_custkey""", star=True)
def B3_upsert_edges(spark, sf):
    from graphmill.model import as_edges

    nodes, edges = star(spark, sf)
    new = as_edges(table(spark, sf, "customer").selectExpr("'ALIASES' AS edge_type", "concat('file:c', c_custkey) AS source_id", "concat('file:s', c_custkey) AS target_id", "'twin' AS kind"))
    return merge.merge_edges(edges, new, nodes).select("id", "edge_type", "source_id", "target_id", "kind")


CLOSURE = ", down AS (SELECT id FROM star_nodes WHERE {seed} UNION SELECT e.target_id FROM down d JOIN star_edges e ON e.source_id = d.id AND e.edge_type = 'CONTAINS')"


@query(
    CLOSURE.format(seed="id IN ('file:c7', 'file:c8', 'file:c10')") + ", gone AS (SELECT id FROM down UNION SELECT anchor FROM star_anchors JOIN down ON owner = id) SELECT (SELECT count(*) FROM gone) AS deleted_nodes, (SELECT count(*) FROM star_nodes WHERE id NOT IN (FROM gone)) + (SELECT count(*) FROM star_anchors WHERE anchor NOT IN (FROM gone)) AS nodes_left, (SELECT count(*) FROM star_edges WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone)) + (SELECT count(*) FROM star_anchors WHERE owner NOT IN (FROM gone)) AS edges_left",
    star=True,
)
def B4_F6_delete_files(spark, sf):
    nodes, edges = star(spark, sf, anchors=True)
    gone = traversal.cut(merge.file_subgraph_ids(nodes, edges, ids(spark, "file:c7", "file:c8", "file:c10")))
    left_nodes, left_edges = merge.delete_nodes(nodes, edges, gone)
    counts = gone.agg(F.count_distinct("id").alias("deleted_nodes"))
    return counts.join(left_nodes.agg(F.count("*").alias("nodes_left")), F.lit(True)).join(left_edges.agg(F.count("*").alias("edges_left")), F.lit(True))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' AS properties FROM events")
def B9_sorted_json(spark, sf):
    pairs = F.map_from_arrays(F.array(F.lit("user"), F.lit("kind")), F.array(F.col("user_id").cast("string"), F.col("event_type")))
    return table(spark, sf, "events").select("event_id", scalar.sorted_json(pairs).alias("properties"))


# ---- filters and presentation ----------------------------------------------------------------------------------------


PROPERTIES_SQL = "CASE node_type WHEN 'File' THEN '{\"relative_path\":\"' || relative_path || '\"}' WHEN 'Entity' THEN '{\"display_name\":\"' || display_name || '\",\"kind_norm\":\"' || kind_norm || '\"' || coalesce(',\"qualified_name\":\"' || qualified_name || '\"', '') || '}' ELSE '{\"name\":\"' || name || '\"}' END"


@query(f" SELECT id, node_type AS type, {LABEL_SQL} AS label, {PROPERTIES_SQL} AS properties FROM star_nodes", star=True)
def D1_D3_visible_nodes(spark, sf):
    return reader.format_node(reader.visible_nodes(star_nodes(spark, sf, anchors=True))).select("id", "type", "label", "properties")


@query(" SELECT id, source_id AS source, target_id AS target, edge_type AS type, kind FROM star_edges", star=True)
def D2_D4_visible_edges(spark, sf):
    nodes, edges = star(spark, sf, anchors=True)
    return reader.format_edge(reader.visible_edges(edges, nodes)).select("id", "source", "target", "type", "kind")


@query("SELECT 'summary:v' || vec_id AS id, 'summary ' || vec_id AS text, 'retrieval' AS purpose, CAST(len(embedding) AS INTEGER) AS embedding_dimensions FROM embeddings")
def D6_format_summary(spark, sf):
    return reader.format_summary(corpus_nodes(spark, sf)).select("id", "text", "purpose", "embedding_dimensions")


@query("SELECT 'file:d' || doc_id AS id, lang || '/' || source || '/' || doc_id AS relative_path, 'text' AS language, 'sha256:' || sha256(text) AS content_hash FROM documents")
def D8_format_source_file(spark, sf):
    return reader.format_source_file(corpus_nodes(spark, sf)).select("id", "relative_path", "language", "content_hash")


@query("SELECT 'file:d' || doc_id AS id, CASE WHEN vec_id IS NOT NULL THEN 'summary ' || vec_id END AS generated_summary FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def D9_generated_summary(spark, sf):
    nodes, edges = corpus(spark, sf)
    return reader.with_summaries(nodes.filter("node_type = 'File'"), nodes, edges).select("id", "generated_summary")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'CONTAINS' ELSE 'ALIASES,CONTAINS' END AS types FROM events")
def D10_visible_edge_types(spark, sf):
    wanted = F.when(F.col("event_type") == "click", F.array(F.lit("CONTAINS"), F.lit("HAS_ANCHOR"))).otherwise(F.array(*map(F.lit, ("ALIASES", "CONTAINS", "ALIASES", "DESCRIBES"))))
    return table(spark, sf, "events").select("event_id", F.array_join(scalar.visible_types(wanted, reader.VISIBLE_EDGE_TYPES), ",").alias("types"))


@query("SELECT 'entity:p' || p_partkey AS id, NULL AS warning, p_partkey % 2 = 1 AS open FROM part UNION ALL SELECT 'entity:none' || s_suppkey, 'unknown node: entity:none' || s_suppkey, false FROM supplier")
def D12_D13_known_ids(spark, sf):
    """Every part and as many unknown ids as there are suppliers, where half of the parts have been visited."""
    parts = table(spark, sf, "part").selectExpr("concat('entity:p', p_partkey) AS id", "p_partkey")
    wanted = parts.select("id").unionByName(table(spark, sf, "supplier").selectExpr("concat('entity:none', s_suppkey) AS id"))
    return reader.known_nodes(wanted, star_nodes(spark, sf), parts.filter("p_partkey % 2 = 0"))


# ---- joins -----------------------------------------------------------------------------------------------------------


@query(f" SELECT id, node_type AS type, {LABEL_SQL} AS label FROM star_nodes WHERE id = 'entity:p3'", star=True)
def E1_node_by_id(spark, sf):
    return reader.format_node(reader.node_by_id(star_nodes(spark, sf), "entity:p3")).select("id", "type", "label")


@query("SELECT 'file:d' || doc_id AS id, lang || '/' || source || '/' || doc_id AS relative_path FROM documents")
def E2_source_file(spark, sf):
    """The lookup by path, for every path."""
    paths = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("relative_path"))
    return reader.source_files(corpus_nodes(spark, sf), paths).select("id", "relative_path")


HOPS = f""", ends AS (
  SELECT o.id AS origin, e.*, 'outgoing' AS direction, e.target_id AS other FROM seeds o JOIN star_edges e ON e.source_id = o.id
  UNION ALL SELECT o.id, e.*, 'incoming', e.source_id FROM seeds o JOIN star_edges e ON e.target_id = o.id AND e.source_id <> o.id),
hops AS (
  SELECT e.origin, e.id AS edge_id, e.edge_type, e.kind, e.source_id, e.target_id, e.direction,
         n.id AS neighbor, n.node_type AS neighbor_type, {LABEL_SQL.replace('node_type', 'n.node_type')} AS neighbor_label
  FROM ends e JOIN star_nodes n ON n.id = e.other)"""


@query(", seeds AS (SELECT 'entity:p1' AS id)" + HOPS + " SELECT * FROM hops", star=True)
def E3_expand_graph(spark, sf):
    nodes, edges = star(spark, sf)
    return reader.expand(nodes, edges, ids(spark, "entity:p1"))


@query(", seeds AS (SELECT 'entity:p1' AS id UNION ALL SELECT 'file:s1')" + HOPS + " SELECT * FROM hops", star=True)
def E3_J6_stored_neighbors(spark, sf):
    """Expansion over a stored graph, of which only the buckets of the ids and their neighbours are opened."""
    seeds = ids(spark, "entity:p1", "file:s1")
    return reader.expand(*stored(spark, sf).around(seeds), seeds)


@query(", seeds AS (SELECT 'entity:p' || p_partkey AS id FROM part)" + HOPS + " SELECT DISTINCT neighbor AS id, neighbor_type AS type, neighbor_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY edge_id) AS n FROM hops) WHERE n <= 5", star=True)
def E4_neighbors(spark, sf):
    nodes, edges = star(spark, sf)
    seeds = table(spark, sf, "part").selectExpr("concat('entity:p', p_partkey) AS id")
    return reader.neighbors(nodes, edges, seeds, limit=5)


@query(", seeds AS (SELECT 'file:c1' AS id)" + HOPS + " SELECT DISTINCT neighbor AS id, neighbor_type AS type, neighbor_label AS label FROM hops", star=True)
def E5_related_nodes(spark, sf):
    nodes, edges = star(spark, sf)
    return reader.neighbors(nodes, edges, ids(spark, "file:c1"))


@query("WITH " + STAR_SQL + " SELECT owner, anchor AS id, 'body' AS role, l_linenumber AS start_line FROM star_anchors WHERE owner IN ('entity:o1', 'entity:o2', 'entity:o3', 'entity:o4')")
def E6_D7_H4_anchors(spark, sf):
    nodes, edges = star(spark, sf, anchors=True)
    return reader.anchors_of(nodes, edges, ids(spark, *(f"entity:o{k}" for k in (1, 2, 3, 4)))).select("owner", "id", "role", "start_line")


@query("SELECT 'file:d' || doc_id AS id, 'summary ' || vec_id AS generated_summary FROM documents JOIN embeddings ON vec_id = doc_id")
def E7_retrieval_summaries(spark, sf):
    nodes, edges = corpus(spark, sf)
    return reader.retrieval_summaries(nodes, edges, nodes.filter("node_type = 'File'"))


@query(" SELECT 'entity:o' || o_orderkey AS seed, 'file:c' || o_custkey AS id FROM orders UNION ALL SELECT 'file:s' || s_suppkey, 'file:s' || s_suppkey FROM supplier", star=True)
def E8_E18_source_file_of_node(spark, sf):
    nodes, edges = star(spark, sf)
    seeds = table(spark, sf, "orders").selectExpr("concat('entity:o', o_orderkey) AS id")
    seeds = seeds.unionByName(table(spark, sf, "supplier").selectExpr("concat('file:s', s_suppkey) AS id")).unionByName(table(spark, sf, "nation").selectExpr("concat('module:n', n_nationkey) AS id"))
    return traversal.source_files_of(nodes, edges, seeds)


def embedding_queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


NEAREST = """SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"""


@query(f"SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({NEAREST}) WHERE rank <= 10")
def E10_H5_nearest(spark, sf):
    return retrieval.nearest(embedding_queries(spark, sf), table(spark, sf, "embeddings"), 10, "vec_id").select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({NEAREST}) WHERE rank <= 10")
def B5_H5_indexed_nearest(spark, sf):
    """The inverted-file index, built over all vectors and asked in all of its cells, where it has to equal the exact search."""
    index = vector_index.build_index(table(spark, sf, "embeddings"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "vec_id")
    found = vector_index.search_index(index, embedding_queries(spark, sf), 10, probes=len(index.centres))
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH s AS (SELECT o_custkey AS scope, o_orderkey AS owner, min(l_shipdate) AS f, max(l_shipdate) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT DISTINCT o_custkey AS scope, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.scope, l_orderkey, l_linenumber, l_shipdate AS at, arg_min(owner, (l - f, owner)) AS owner FROM p JOIN s ON s.scope = p.scope AND l_shipdate BETWEEN f AND l GROUP BY ALL""")
def E11_innermost_time(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("scope")), "l_orderkey")
    spans = lines.groupBy("scope", F.col("l_orderkey").alias("owner")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    points = lines.select("scope", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at")).distinct()
    return intervals.innermost_time(points, spans)


@query("WITH ups AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1) SELECT a.o_orderkey AS method, b.o_orderkey AS overridden FROM orders a JOIN ups ON a.o_custkey = child JOIN orders b ON b.o_custkey = parent AND a.o_orderpriority = b.o_orderpriority")
def E15_F10_F11_overrides(spark, sf):
    """Each customer has two supertypes, of a third and of half its number; the later one counts."""
    c = table(spark, sf, "customer").filter("c_custkey > 1").select("c_custkey", F.explode(F.array(F.lit(3), F.lit(2))).alias("part"))
    up = c.select(F.col("c_custkey").alias("source_id"), F.expr("c_custkey div part").alias("target_id"), F.lit("SPECIALIZES").alias("edge_type"), F.lit("extends").alias("kind"), (-F.col("part")).alias("ord"), F.col("part").alias("id"))
    owned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("method"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("owner"))
    return semantics.override_pairs(owned, semantics.last_supertypes(up))


@query("WITH c AS (SELECT doc_id, first_value(doc_id) OVER w AS canon FROM documents WINDOW w AS (PARTITION BY text ORDER BY source, doc_id)) SELECT doc_id AS source_id, canon AS target_id, 'duplicate-entity' AS kind FROM c WHERE doc_id <> canon AND (SELECT text FROM documents d WHERE d.doc_id = c.doc_id) <> ''")
def E16_aliases(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("entity_key"), F.lit("internal").alias("origin"), F.col("source").alias("file_path"), (F.col("text") != "").alias("held"))
    out = semantics.alias_edges(docs.filter("held"))
    return out.select(F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id"), "kind")


@query("SELECT l_orderkey AS owner, CAST(l_linenumber AS VARCHAR) AS role, CAST(arg_max(l_partkey, (epoch_us(l_shipdate), l_suppkey || ':' || l_partkey)) AS INTEGER) AS start_line FROM lineitem GROUP BY ALL")
def E17_last_anchor(spark, sf):
    """Of the lines with one order and number, as anchors of one role, the last shipped one counts."""
    name = F.concat_ws(":", "l_suppkey", "l_partkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("role"), F.col("l_partkey").cast("int").alias("start_line"), name.alias("id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ord"))
    edges = lines.select(F.lit("HAS_ANCHOR").alias("edge_type"), F.col("l_orderkey").alias("source_id"), F.col("id").alias("target_id"), "role", "ord")
    nodes = lines.select("id", F.lit("Anchor").alias("node_type"), "start_line", *(F.lit(1).alias(c) for c in ("start_col", "end_line", "end_col"))).dropDuplicates(["id"])
    return intervals.entity_anchors(nodes, edges).select("owner", "role", "start_line")


OLD_NEW = "c AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 5 <> 0), p AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)"


def versions(spark, sf):
    docs = table(spark, sf, "documents")
    edited = F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))
    current = docs.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("path"), F.sha2(edited, 256).alias("content_hash"))
    return current, docs.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))


CHANGES = f"WITH {OLD_NEW} SELECT doc_id AS path, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN c.h <> p.h THEN 'modified' ELSE 'unchanged' END AS status FROM c FULL JOIN p USING (doc_id)"


@query(CHANGES)
def E19_I2_file_changes(spark, sf):
    return merge.file_changes(*versions(spark, sf))


@query(f"{CHANGES.replace('SELECT doc_id AS path', 'SELECT CAST(doc_id AS VARCHAR) AS path')} WHERE p.h IS NULL OR c.h IS NULL OR c.h <> p.h")
def E19_M_change_stream(spark, sf):
    """The same changes as a stream with state: all first versions, then the second ones, deletions and late first ones in another run."""
    current, before = versions(spark, sf)
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    first = before.select(F.col("path").cast("string").alias("path"), F.lit(1).cast("long").alias("version"), "content_hash")
    gone = before.join(current, "path", "left_anti").select(F.col("path").cast("string").alias("path"), F.lit(2).cast("long").alias("version"), F.lit(None).cast("string").alias("content_hash"))
    second = current.select(F.col("path").cast("string").alias("path"), F.lit(2).cast("long").alias("version"), "content_hash").unionByName(gone)
    for rows in (first, second.unionByName(first)):
        rows.write.mode("append").parquet(f"{where}/in")
        changed = changes.file_change_stream(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
        changed.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out", format="parquet", outputMode="append").awaitTermination()
    return spark.read.schema(changes.CHANGED).parquet(f"{where}/out").filter("version = 2").select("path", "status")



@query("SELECT p_brand || p_type || p_size AS qualified_name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1")
def E20_unique_name(spark, sf):
    return semantics.unique_by_qualified_name(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("qualified_name")))


@query(", seeds AS (SELECT 'entity:p1' AS id)" + HOPS + " SELECT origin, neighbor, direction FROM hops WHERE edge_type = 'SPECIALIZES' AND direction = 'incoming'", star=True)
def E21_query_relation(spark, sf):
    nodes, edges = star(spark, sf)
    return reader.expand(nodes, edges, ids(spark, "entity:p1"), "incoming", ("SPECIALIZES",)).select("origin", "neighbor", "direction")


@query(", seeds AS (SELECT 'entity:o' || o_orderkey AS id FROM orders)" + HOPS + " SELECT origin, edge_id, neighbor, direction FROM hops WHERE edge_type IN ('DEPENDS_ON', 'CONTAINS')", star=True)
def E22_expand_neighbors(spark, sf):
    nodes, edges = star(spark, sf)
    seeds = table(spark, sf, "orders").selectExpr("concat('entity:o', o_orderkey) AS id")
    return reader.expand(nodes, edges, seeds, "both", ("DEPENDS_ON", "CONTAINS")).select("origin", "edge_id", "neighbor", "direction")


# Texts get a character of four bytes before every c, so that each line has columns on all sides of such characters.
WIDE = "\U0001d11e"


@query(f"""WITH w AS (SELECT doc_id, string_split(replace(text, 'c', '{WIDE}c'), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i AS line, lines[i] AS body FROM w, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
h AS (SELECT doc_id, line, k, left(body, CAST(length(body) * k // 3 AS BIGINT)) AS head FROM l, (VALUES (1), (2), (3)) t(k))
SELECT doc_id, line, strlen(head) AS byte_column, CAST(length(head) + length(head) - length(regexp_replace(head, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER) AS utf16 FROM h""")
def E25_utf16_column(spark, sf):
    """UTF-16 columns at a third, two thirds and the end of every line of every whole text."""
    wide = F.split(F.replace("text", F.lit("c"), F.lit(WIDE + "c")), "\n", -1)
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(wide).alias("at", "body"))
    cut_at = F.expr("left(body, length(body) * k div 3)")
    heads = lines.select("doc_id", (F.col("at") + 1).alias("line"), "body", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).withColumn("byte_column", F.octet_length(cut_at))
    return heads.select("doc_id", "line", F.col("byte_column").cast("long").alias("byte_column"), scalar.utf16_column(F.col("body"), F.col("byte_column")).alias("utf16"))


# ---- aggregations, order, sets ---------------------------------------------------------------------------------------


@query(" SELECT (SELECT count(*) FROM star_nodes) AS node_count, (SELECT count(*) FROM star_edges) AS edge_count", star=True)
def F1_F2_overview(spark, sf):
    return reader.overview(*star(spark, sf, anchors=True))


@query(" SELECT node_type AS type, count(*) AS count FROM star_nodes GROUP BY 1", star=True)
def F3_type_counts(spark, sf):
    return reader.node_type_counts(star_nodes(spark, sf))


@query(" SELECT (SELECT count(*) FROM star_nodes) AS nodes, count(*) AS edges, count(*) FILTER (edge_type <> 'CONTAINS') AS semantic_edges, CAST(0 AS BIGINT) AS resolved_edges FROM star_edges", star=True)
def F4_F5_graph_counts(spark, sf):
    return reader.graph_counts(*star(spark, sf))


@query("SELECT CAST(count(DISTINCT len(embedding)) AS BIGINT) AS dimension_count FROM embeddings")
def F7_dimension_check(spark, sf):
    return merge.dimension_check(corpus_nodes(spark, sf))


@query(f"WITH h AS (SELECT * FROM ({NEAREST}) WHERE rank <= 20), b AS (SELECT id, max(score) AS score, min((query, rank)) AS seen FROM h WHERE score > 0 GROUP BY id) SELECT 'file:d' || id AS id, round(score, 6) AS vector_score, CAST(row_number() OVER (ORDER BY seen) - 1 AS INTEGER) AS index FROM b JOIN documents ON doc_id = id")
def D14_F8_seed_candidates(spark, sf):
    nodes, edges = corpus(spark, sf)
    hits = retrieval.nearest(embedding_queries(spark, sf), nodes.filter("embedding is not null"), 20)
    return retrieval.seed_candidates(hits, nodes, edges).select("id", F.round("vector_score", 6).alias("vector_score"), "index")


@query("SELECT o_custkey AS file, count(*) AS entities, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS listed FROM orders GROUP BY 1")
def F9_group_to_list(spark, sf):
    found = merge.grouped_list(table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey"), "file", "o_orderkey")
    return found.select("file", F.col("n").alias("entities"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("listed"))


@query("WITH x AS (" + CHANGES + ") SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "modified", "deleted", "unchanged")) + " FROM x")
def F13_change_counts(spark, sf):
    return merge.change_counts(merge.file_changes(*versions(spark, sf)))


WINDOW = """, win AS (SELECT * FROM star_nodes ORDER BY CASE node_type WHEN 'Repository' THEN 0 WHEN 'Module' THEN 1 WHEN 'File' THEN 2 ELSE 3 END,
  CASE kind_norm WHEN 'class' THEN 0 ELSE 6 END, coalesce(relative_path, qualified_name, display_name, name, id), id LIMIT 300)"""


@query(WINDOW + f" SELECT id, node_type AS type, {LABEL_SQL} AS label FROM win", star=True)
def H1_node_window(spark, sf):
    return reader.format_node(reader.node_window(star_nodes(spark, sf), 300)).select("id", "type", "label")


@query(WINDOW + " SELECT id, source_id, target_id, edge_type FROM star_edges WHERE source_id IN (SELECT id FROM win) AND target_id IN (SELECT id FROM win) ORDER BY CASE edge_type WHEN 'CONTAINS' THEN 0 ELSE 1 END, source_id, target_id, id LIMIT 600", star=True)
def H2_H3_E9_window_edges(spark, sf):
    nodes, edges = star(spark, sf)
    return reader.window_edges(reader.node_window(nodes, 300), edges, 300).select("id", "source_id", "target_id", "edge_type")


RERANK = f"WITH h AS (SELECT * FROM ({NEAREST}) WHERE rank <= 20), b AS (SELECT id, max(score) AS score, min((query, rank)) AS seen FROM h WHERE score > 0 GROUP BY id), c AS (SELECT 'file:d' || id AS id, id AS n, lang || '/' || source || '/' || id AS label, score, row_number() OVER (ORDER BY seen) - 1 AS index FROM b JOIN documents ON doc_id = id), s AS (SELECT *, CASE WHEN index % 3 = 0 THEN (n * 37 % 101) / 100.0 END AS r FROM c)"


@query(RERANK + " SELECT id, round(r, 6) AS rerank_score, round(score, 6) AS vector_score FROM (SELECT *, row_number() OVER (ORDER BY r IS NULL, CASE WHEN r IS NULL THEN -score END, CASE WHEN r IS NULL THEN label END, index) AS turn FROM s) WHERE turn <= 12 OR r IS NOT NULL ORDER BY coalesce(r, -1) DESC, score DESC, label, id LIMIT 12")
def H6_H7_N6_reranked(spark, sf):
    nodes, edges = corpus(spark, sf)
    hits = retrieval.nearest(embedding_queries(spark, sf), nodes.filter("embedding is not null"), 20)
    found = traversal.cut(retrieval.seed_candidates(hits, nodes, edges))
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    scores = found.filter("index % 3 = 0").select("index", (number * 37 % 101 / 100.0).alias("rerank_score"))
    return retrieval.reranked(found, scores, 12).select("id", F.round("rerank_score", 6).alias("rerank_score"), F.round("vector_score", 6).alias("vector_score"))


@query(f" SELECT id, node_type AS type, {LABEL_SQL} AS label FROM star_nodes WHERE starts_with(lower(coalesce(name, '')), 'customer#00000001') OR starts_with(lower(coalesce(relative_path, '')), 'customer#00000001') ORDER BY coalesce(display_name, qualified_name, relative_path, name, id), id LIMIT 20", star=True)
def H8_auto_complete(spark, sf):
    return reader.auto_complete(star_nodes(spark, sf), " Customer#00000001", 20)


@query(f", new AS ({CHANGED_FILES}), star_now AS (SELECT id, coalesce(n.node_type, o.node_type) AS node_type, coalesce(n.name, o.name) AS name, coalesce(n.relative_path, o.relative_path) AS relative_path, o.display_name, o.qualified_name FROM star_nodes o FULL JOIN new n USING (id)) SELECT id, node_type AS type, {LABEL_SQL} AS label FROM star_now WHERE starts_with(lower(name), 'customer#00000001') OR starts_with(lower(relative_path), 'customer#00000001') OR starts_with(lower(display_name), 'customer#00000001') OR starts_with(lower(qualified_name), 'customer#00000001') ORDER BY coalesce(display_name, qualified_name, relative_path, name, id), id LIMIT 50", star=True)
def H8_stored_prefix(spark, sf):
    """Prefix search over the sorted terms of a stored graph, after a change of it."""
    held = stored(spark, sf)
    held.index_terms()
    held.upsert(changed_files(spark, sf), star_edges(spark, sf).limit(0))
    return held.auto_complete(" Customer#00000001", 50)


@query(" SELECT id, node_type, name, relative_path FROM star_nodes UNION ALL SELECT 'file:x' || s_suppkey, 'File', NULL, s_name FROM supplier", star=True)
def I1_union_keep_first(spark, sf):
    return merge.union_keep_first([star_nodes(spark, sf), changed_files(spark, sf)]).select("id", "node_type", "name", "relative_path")


@query(CLOSURE.format(seed="node_type = 'File' AND relative_path IN (SELECT c_name FROM customer WHERE c_custkey % 10 = 0)") + """, sel AS (SELECT id FROM down UNION SELECT 'module:n' || c_nationkey FROM customer WHERE c_custkey % 10 = 0 UNION SELECT 'repo:r' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0)
SELECT e.id FROM star_edges e WHERE (source_id IN (FROM sel) AND target_id IN (FROM sel)) OR (edge_type <> 'CONTAINS' AND (source_id IN (FROM sel) OR target_id IN (FROM sel)))""", star=True)
def I4_J5_incremental_edges(spark, sf):
    nodes, edges = star(spark, sf)
    changed = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_name").alias("relative_path"))
    return merge.select_incremental(nodes, edges, traversal.cut(merge.incremental_ids(nodes, edges, changed)))[1].select("id")


@query("SELECT 'summary:v' || vec_id AS id FROM embeddings JOIN documents ON doc_id = vec_id WHERE doc_id % 4 = 0")
def I5_I6_stale_summaries(spark, sf):
    nodes, edges = corpus(spark, sf)
    targets = table(spark, sf, "documents").selectExpr("concat('file:d', doc_id) AS id", "doc_id % 4 != 0 AS current")
    return merge.stale_summaries(nodes, edges, targets)


@query("SELECT l_orderkey AS id, arg_min(l_partkey, (l_shipdate, l_partkey)) AS first_part FROM lineitem GROUP BY 1")
def I7_keep_first(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("first_part"), F.struct("l_shipdate", "l_partkey").alias("ord"))
    return merge.keep_first(lines).select("id", "first_part")


SUMMARISED = """n AS (SELECT 'file:d' || doc_id AS id, 'sha256:' || sha256(text) AS h, doc_id % 4 AS m, 'File text ' || lang || '/' || source || '/' || doc_id AS about FROM documents)"""


def summarised(spark, sf):
    """The documents as files: a quarter with a current summary, a quarter with one of an old text, a quarter with one of
    another model, a quarter without one."""
    from graphmill.model import as_nodes

    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file:d"), F.col("doc_id").cast("string")).alias("id"), scalar.prefixed_sha256(F.col("text")).alias("content_hash"), F.concat_ws("/", "lang", "source", "doc_id").alias("relative_path"))
    files = as_nodes(docs.withColumns({"node_type": F.lit("File"), "language": F.lit("text")}))
    m = F.col("doc_id") % 4
    held = docs.filter(m < 3).select(
        F.concat(F.lit("summary:"), "id", F.lit(":retrieval")).alias("id"), F.lit("Summary").alias("node_type"), F.lit("old").alias("text"), F.lit("retrieval").alias("purpose"), F.when(m == 1, "sha256:0").otherwise(F.col("content_hash")).alias("source_hash"),
        F.when(m == 2, "other").otherwise("local-echo").alias("summary_model"), F.lit("local-hashed").alias("embedding_model"), F.lit(16).alias("embedding_dimensions"), F.array(F.lit(1.0), *[F.lit(0.0)] * 15).cast("array<float>").alias("embedding"),
    )
    return files.unionByName(as_nodes(held))


@query(f"WITH {SUMMARISED} SELECT id, h AS target_hash, m = 0 AS current FROM n")
def E23_summary_currency(spark, sf):
    return summaries.targets(summarised(spark, sf), "local-echo", "local-hashed", 16).select("id", "target_hash", "current")


PROMPT_SQL = f"""'{summaries.LEAD} Node: ' || id || ' About: ' || about"""


@query(f"WITH {SUMMARISED} SELECT id, replace({PROMPT_SQL}, ' Node: ', chr(10) || 'Node: ').replace(' About: ', chr(10) || 'About: ') AS prompt FROM n")
def L1_summary_prompts(spark, sf):
    return summarised(spark, sf).filter("node_type = 'File'").select("id", summaries.summary_prompt().alias("prompt"))


@query(f"WITH {SUMMARISED} SELECT 'summary:' || id || ':retrieval' AS id, CASE WHEN m = 0 THEN 'old' ELSE {PROMPT_SQL} END AS text, h AS source_hash, 'local-echo' AS summary_model, CAST(16 AS INTEGER) AS embedding_dimensions, true AS unit FROM n")
def L2_L3_L4_L7_summaries(spark, sf):
    """After a refresh every file has a current summary; only those without one went through the models."""
    nodes, _ = summaries.attach(summarised(spark, sf), star_edges(spark, sf).limit(0), EchoSummaries(), HashedEmbeddings(16), 25)
    made = nodes.filter("node_type = 'Summary'")
    return made.select("id", "text", "source_hash", "summary_model", "embedding_dimensions", (F.abs(scalar.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-5).alias("unit"))


@query(f"WITH {SUMMARISED} SELECT 'summary:' || id || ':retrieval' AS source_id, id AS target_id, 'retrieval' AS kind FROM n")
def E24_summary_edges(spark, sf):
    _, edges = summaries.attach(summarised(spark, sf), star_edges(spark, sf).limit(0), EchoSummaries(), HashedEmbeddings(16), 25)
    return edges.filter("edge_type = 'DESCRIBES'").select("source_id", "target_id", "kind")


@query("SELECT 'file:d' || doc_id AS id, round(len(list_intersect(list_distinct(string_split(lang || ' ' || source, ' ')), ['en', 'src1'])) / 2.0, 6) AS score FROM documents")
def L5_rerank_scores(spark, sf):
    """The stand-in reranker over every document's language and source, in batches on the executors."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("file:d"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws(" ", "lang", "source").alias("text"))
    return retrieval.scored(docs, "en src1", OverlapReranker()).select("id", F.round("score", 6).alias("score"))


# ---- traversal -------------------------------------------------------------------------------------------------------


@query(""", walk AS (SELECT 'repo:r1' AS spot, 'repo:r1' AS path, 0 AS depth UNION ALL SELECT e.target_id, w.path || '>' || e.target_id, depth + 1 FROM walk w JOIN star_edges e ON e.source_id = w.spot WHERE depth < 4)
SELECT spot AS target_id, CAST(depth AS INTEGER) AS depth, path FROM walk WHERE depth > 0 AND spot IN (SELECT 'entity:o' || o_orderkey FROM orders)""", star=True)
def J1_trails(spark, sf):
    targets = table(spark, sf, "orders").selectExpr("concat('entity:o', o_orderkey) AS id")
    return traversal.trails(star_edges(spark, sf), ids(spark, "repo:r1"), targets, 4).select("target_id", "depth", "path")


@query(CLOSURE.format(seed="id = 'repo:r2'") + " SELECT id FROM down", star=True)
def J2_J4_descendants(spark, sf):
    return traversal.descendants(star_edges(spark, sf), ids(spark, "repo:r2")).select("id")


@query(""", c AS (SELECT source_id, target_id FROM star_edges WHERE edge_type = 'CONTAINS'),
down AS (SELECT id AS seed, id, 0 AS depth FROM star_nodes WHERE node_type IN ('Repository', 'Module') UNION ALL SELECT seed, target_id, depth + 1 FROM down JOIN c ON source_id = id),
up AS (SELECT id AS seed, id, 0 AS depth FROM star_nodes WHERE node_type = 'Entity' UNION ALL SELECT seed, source_id, depth + 1 FROM up JOIN c ON target_id = id)
SELECT 'down' AS way, seed, id, depth FROM down UNION ALL SELECT 'up', seed, id, depth FROM up WHERE id IN (SELECT id FROM star_nodes WHERE node_type <> 'Entity')""", star=True)
def J2_J3_J4_labelled_closures(spark, sf):
    """What lies below every repository and module, and above every entity, by interval labels of the containment forest."""
    nodes, held = star_nodes(spark, sf), labels.forest_labels(star_edges(spark, sf))
    seeds = lambda *kinds: nodes.filter(F.col("node_type").isin(*kinds)).select("id")
    down = labels.descendants(held, seeds("Repository", "Module")).select(F.lit("down").alias("way"), "seed", "id", "depth")
    return down.unionByName(labels.ancestors(nodes, held, seeds("Entity")).select(F.lit("up").alias("way"), "seed", "id", "depth"))


@query(" SELECT 'file:c' || c_custkey AS seed, unnest(['file:c' || c_custkey, 'module:n' || c_nationkey, 'repo:r' || n_regionkey]) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey", star=True)
def J3_ancestors(spark, sf):
    nodes, edges = star(spark, sf)
    seeds = table(spark, sf, "customer").selectExpr("concat('file:c', c_custkey) AS id")
    return traversal.ancestors(nodes, edges, seeds).select("seed", "id")


@query(", one AS (SELECT DISTINCT target_id AS id FROM star_edges WHERE source_id = 'entity:o1' AND edge_type = 'DEPENDS_ON'), two AS (SELECT DISTINCT source_id AS id FROM star_edges WHERE target_id IN (FROM one) AND edge_type = 'DEPENDS_ON') SELECT id FROM two WHERE id <> 'entity:o1'", star=True)
def J6_two_hops(spark, sf):
    nodes, edges = star(spark, sf)
    one = reader.expand(nodes, edges, ids(spark, "entity:o1"), "outgoing", ("DEPENDS_ON",)).select(F.col("neighbor").alias("id"))
    two = reader.expand(nodes, edges, one, "incoming", ("DEPENDS_ON",)).select(F.col("neighbor").alias("id")).distinct()
    return two.filter("id != 'entity:o1'")


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS line FROM documents")
def K_one_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalar.one_line(F.col("text")).alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def K_json_get(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def K_escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalar.escape_html(F.col("html")).alias("escaped"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine FROM embeddings")
def K_cosine(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalar.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))


def queries() -> dict:
    return QUERIES | java_corpus.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | java_corpus.SQL
