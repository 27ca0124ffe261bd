"""Indexing a repository into a store, whole or by what has changed."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphmill.functions.models import EchoSummaries, EmbeddingModel, HashedEmbeddings, TextModel
from graphmill.java.graph import Built, build_all
from graphmill.model import SEMANTIC_EDGE_TYPES
from graphmill.operators import maintenance, merge, summaries
from graphmill.operators.traversal import cut
from graphmill.sources.repository import scan
from graphmill.sources.store import GraphStore


#: Paths of each kind of change that an answer lists; it counts them all.
LISTED = 10_000


@dataclass
class IndexResult:
    mode: str
    added: list[str]
    modified: list[str]
    deleted: list[str]
    skipped: int
    deleted_nodes: int
    nodes: int
    edges: int
    duration_ms: int
    n_added: int = 0
    n_modified: int = 0
    n_deleted: int = 0


def index(
    spark: SparkSession, repository: str, store: GraphStore, name: str, incremental: bool = False, text_model: TextModel | None = None, embedding_model: EmbeddingModel | None = None, batch: int = 25,
    repair_inbound: bool = False,
) -> IndexResult:
    """Scans, builds, summarises and stores. A refresh re-reads all files for structure, but takes uses only from changed
    files and writes only what belongs to them; inbound uses from unchanged files come back as references alone.

    repair_inbound: uses of unchanged files that a change reaches are resolved again too, and edges that are no more go,
    so that a refresh leaves the edges that a full index would.
    """
    began = time.perf_counter()
    text_model, embedding_model = text_model or EchoSummaries(), embedding_model or HashedEmbeddings()
    files = cut(scan(spark, repository))
    previous = store.file_hashes() if incremental else spark.createDataFrame([], "path string, content_hash string")
    changes = cut(merge.file_changes(files.select("path", "content_hash"), previous))
    of = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
    listed = {s: [r.path for r in changes.filter(F.col("status") == s).orderBy("path").limit(LISTED).select("path").collect()] for s in ("added", "modified", "deleted")}
    deleted_nodes = 0
    if not incremental:
        made = build_all(files, name)
        # Stored before it is written, as the store reads a graph several times and a model is asked once.
        nodes, edges = (cut(x) for x in summaries.attach(made.nodes, made.edges, text_model, embedding_model, batch))
        store.overwrite(nodes, edges, made.uses)
    elif any(listed.values()):
        paths = changes.filter("status in ('added', 'modified')").select("path")
        gone = changes.filter("status in ('modified', 'deleted')").select("path")
        old_nodes, old_edges = store.read()
        before = Built(old_nodes, old_edges, store.uses()) if repair_inbound else None
        made = build_all(files, name, paths, before=before, gone=gone)
        nodes, edges = made.nodes, made.edges
        ids = cut(merge.incremental_ids(nodes, edges, paths.withColumnRenamed("path", "relative_path")))
        own_nodes, own_edges = (cut(x) for x in summaries.attach(*merge.select_incremental(nodes, edges, ids), text_model, embedding_model, batch))
        again = changes.filter("status != 'unchanged'").select("path") if made.again is None else made.again
        gone_edges = None
        if repair_inbound:
            semantic = F.col("edge_type").isin(*SEMANTIC_EDGE_TYPES)
            gone_edges, written = (cut(x) for x in maintenance.edge_changes(old_edges.filter(semantic), edges.filter(semantic)))
            own_edges = merge.union_keep_first([own_edges, written])
        deleted_nodes = store.refresh(gone, own_nodes, own_edges, gone_edges, made.uses, again)
    nodes, edges = store.read()
    counts = {f"n_{s}": of.get(s, 0) for s in ("added", "modified", "deleted")}
    result = IndexResult("incremental" if incremental else "full", listed["added"], listed["modified"], listed["deleted"], of.get("unchanged", 0), deleted_nodes, nodes.count(), edges.count(), round(1000 * (time.perf_counter() - began)), **counts)
    state = {"repository": repository, "name": name, "indexed_at": datetime.now(timezone.utc).isoformat(), "result": asdict(result)}
    store.write_text("state", json.dumps(state, sort_keys=True, ensure_ascii=False))
    return result
