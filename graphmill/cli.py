"""Command line: init, index, web, and the retrieval tools. Usage errors exit with 2, failures with 1."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from graphmill.config import chat_client, default_config, embedding_model, read_config, rerank_model, text_model
from graphmill.model import VISIBLE_EDGE_TYPES


def filled(text: str) -> str:
    if not text.strip():
        raise argparse.ArgumentTypeError("must not be blank")
    return text.strip()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphmill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "web"):
        commands.add_parser(name).add_argument("repository", type=filled)
    commands.choices["index"].add_argument("--incremental", action="store_true")
    tools = commands.add_parser("tools").add_subparsers(dest="tool", required=True)
    seeds, expand, relation = (tools.add_parser(n) for n in ("vector-search-seeds", "expand-neighbors", "query-relation"))
    seeds.add_argument("--query", action="append", type=filled, required=True)
    for p in (expand, relation):
        p.add_argument("--node-id", action="append", type=filled, required=True)
        p.add_argument("--direction", default="both")
    expand.add_argument("--edge-type", action="append", type=filled)
    relation.add_argument("--relation-type", type=filled, required=True)
    for p in (seeds, expand, relation):
        p.add_argument("--repository", default=".")
    return top


def run(args: argparse.Namespace, session=None) -> dict:
    home = Path(args.repository) / ".graphmill"
    config_path = home / "config.json"
    if args.command == "init":
        home.mkdir(parents=True, exist_ok=True)
        if not config_path.exists():
            config_path.write_text(json.dumps(default_config(), indent=2) + "\n", encoding="utf-8")
        return {"status": "ok", "config": str(config_path)}
    if args.command == "tools":
        if getattr(args, "direction", "both") not in ("outgoing", "incoming", "both"):
            raise RuntimeError(f"unknown direction: {args.direction}")
        asked = (getattr(args, "edge_type", None) or []) + ([args.relation_type] if getattr(args, "relation_type", None) else [])
        if wrong := [t for t in asked if t not in VISIBLE_EDGE_TYPES]:
            raise RuntimeError(f"edge type not available: {', '.join(wrong)}")
    config = read_config(config_path)
    from graphmill.plans.agent import Toolbox
    from graphmill.plans.index import index
    from graphmill.sources.store import GraphStore

    spark = session or started(config["graphrag"])
    root = Path(args.repository).resolve()
    store = GraphStore(spark, (home / "graph").resolve().as_uri())
    embedding = embedding_model(config)
    update = lambda incremental: asdict(index(spark, str(root), store, root.name, incremental, text_model(config), embedding, config["embedding"]["batch_size"]))
    if args.command == "index":
        return update(args.incremental)
    if not store.exists():
        raise RuntimeError("no index; run index first")
    box = lambda enforce: Toolbox(spark, store, embedding, rerank_model(config), config["rerank"]["candidate_limit_per_query"], config["rerank"]["top_n"], enforce)
    if args.command == "web":
        from graphmill.web import Service, serve

        serve(Service(store, str(root), lambda: box(True), lambda: update(True), chat_client(config), config), config["web"])
        return {"status": "ok"}
    box = box(False)
    if args.tool == "vector-search-seeds":
        return box.vector_search_seeds(args.query)
    if args.tool == "expand-neighbors":
        return box.expand_neighbors(args.node_id, args.direction, args.edge_type)
    return box.query_relation(args.node_id, args.relation_type, args.direction)


def started(own: dict):
    """The Spark session that the configuration asks for."""
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("graphmill")
    builder = builder.master(own["master"]) if own.get("master") else builder
    builder = builder.config("spark.sql.shuffle.partitions", own["shuffle_partitions"]) if own.get("shuffle_partitions") else builder
    return builder.getOrCreate()


def main(argv: list[str] | None = None, session=None) -> int:
    args = parser().parse_args(argv)
    try:
        print(json.dumps(run(args, session), sort_keys=True, ensure_ascii=False))
    except (RuntimeError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
