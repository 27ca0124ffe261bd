"""The HTTP surface: health, summary, graph window, incremental index and chat, as JSON."""

from __future__ import annotations

import json
import threading
import webbrowser
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from graphmill.functions.clients import ChatClient, ServiceError
from graphmill.operators import reader
from graphmill.plans.agent import Conversation, ModelMind, Toolbox
from graphmill.sources.store import GraphStore

MOST_BODY = 1 << 20


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


@dataclass
class Service:
    """Answers requests as (status, document). tools gives each conversation a toolbox of its own; refresh updates the index."""

    store: GraphStore
    repository: str
    tools: Callable[[], Toolbox]
    refresh: Callable[[], dict]
    chat: ChatClient | None = None
    config: dict = field(default_factory=dict)
    busy: threading.Lock = field(default_factory=threading.Lock)

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
        parts = urlsplit(target)
        found = self.routes().get((method, parts.path))
        try:
            if found is None:
                raise Refused(404, f"no {method} {parts.path}")
            if parts.path != "/api/health" and not self.store.exists():
                raise Refused(404, "no index; run index first")
            return 200, found({k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}, body)
        except Refused as refusal:
            return refusal.status, {"detail": str(refusal)}

    def routes(self) -> dict:
        return {("GET", "/api/health"): self.health, ("GET", "/api/summary"): self.summary, ("GET", "/api/graph"): self.graph, ("POST", "/api/index/incremental"): self.index, ("POST", "/api/chat"): self.converse}

    def health(self, query: dict, body: bytes) -> dict:
        named = {s: {k: self.config.get(s, {}).get(k) for k in ("provider", "model")} for s in ("chat", "embedding")}
        return {"status": "ok" if self.store.exists() else "missing_database", "repository_path": self.repository, "database_path": self.store.root, "last_index": self.store.state()} | named

    def summary(self, query: dict, body: bytes) -> dict:
        nodes, edges = self.store.read()
        counts = reader.overview(nodes, edges).first().asDict()
        return {"status": "success", "summary": counts | {"node_types": [r.asDict() for r in reader.node_type_counts(nodes).collect()]}}

    def graph(self, query: dict, body: bytes) -> dict:
        try:
            limit = int(query["limit"]) if "limit" in query else None
        except ValueError:
            raise Refused(422, "limit is no number") from None
        if limit is not None and limit < 1:
            raise Refused(400, "limit must be at least 1")
        nodes, edges = self.store.read()
        window = reader.node_window(nodes, limit)
        shown = reader.with_summaries(window, nodes, edges).select("id", "generated_summary")
        listed = reader.format_node(window).join(shown, "id").collect()
        described = [r.asDict() | {"properties": json.loads(r.properties) | ({"generated_summary": r.generated_summary} if r.generated_summary else {})} for r in listed]
        for d in described:
            d.pop("generated_summary")
        return {"status": "success", "graph": {"nodes": described, "edges": [r.asDict() for r in reader.format_edge(reader.window_edges(window, edges, limit)).collect()]}}

    def index(self, query: dict, body: bytes) -> dict:
        if not self.busy.acquire(blocking=False):
            raise Refused(409, "the index is being updated")
        try:
            return {"status": "success", "result": self.refresh()}
        except (RuntimeError, ValueError, OSError) as fault:
            raise Refused(500, f"the index could not be updated: {fault}") from fault
        finally:
            self.busy.release()

    def converse(self, query: dict, body: bytes) -> dict:
        if self.chat is None:
            raise Refused(503, "no chat model is configured")
        try:
            messages = json.loads(body or b"{}")["messages"]
            mind = ModelMind(self.chat, json.dumps(self.store.schema(), sort_keys=True), list(messages[:-1]))
            reply = Conversation(self.tools(), mind.plan, mind.answer).ask(messages)
        except ServiceError as fault:
            raise Refused(502, str(fault)) from fault
        except (KeyError, TypeError, ValueError, AttributeError) as fault:
            raise Refused(400, f"no usable messages: {fault}") from fault
        own = self.config.get("chat", {})
        return {"status": "success", "message": reply["message"], "queries": reply["queries"], "model": own.get("model"), "provider": own.get("provider")}


def server(service: Service, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, document = service.answer(self.command, self.path, self.rfile.read(size)) if size <= MOST_BODY else (413, {"detail": "the request is too large"})
            sent = json.dumps(document, sort_keys=True, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(sent)))
            self.end_headers()
            self.wfile.write(sent)

        do_POST = do_GET

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(service: Service, own: dict) -> None:
    """Runs until interrupted."""
    with server(service, own["host"], own["port"]) as running:
        if own["open_browser"]:
            webbrowser.open(f"http://{own['host']}:{own['port']}/api/health")
        running.serve_forever()
