"""The configuration document: its sections, their fields and checks, and the models that it asks for."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path
from typing import Any, NamedTuple

from graphmill.functions import clients, models

LOCAL = "local"


class Field(NamedTuple):
    default: Any
    kind: str
    most: float = math.inf


# Sections, fields, defaults and upper limits.
_MODEL = {"provider": Field(LOCAL, "text"), "model": Field("local", "text"), "api_key": Field("none", "text"), "base_url": Field(None, "text or null"), "timeout_seconds": Field(60.0, "seconds")}
_WRITING = _MODEL | {"temperature": Field(None, "number or null"), "max_output_tokens": Field(None, "count or null")}
SECTIONS: dict[str, dict[str, Field]] = {
    "web": {"host": Field("127.0.0.1", "text"), "port": Field(5000, "count", 65535), "open_browser": Field(True, "flag")},
    "graphrag": {"master": Field(None, "text or null"), "shuffle_partitions": Field(None, "count or null")},
    "chat": _WRITING | {"timeout_seconds": Field(120.0, "seconds")},
    "summary": _WRITING | {"concurrent_requests": Field(10, "count", 32)},
    "embedding": _MODEL | {"dimensions": Field(64, "count or null"), "batch_size": Field(25, "count", 2048), "input_mode": Field("array", "text")},
    "rerank": _MODEL | {"top_n": Field(5, "count"), "candidate_limit_per_query": Field(20, "count"), "failover_enabled": Field(False, "flag")},
}
FORBIDDEN = {"chat": ("system_prompt",), "summary": ("system_prompt",)}
CHECKS: dict[str, Callable[[Any], bool]] = {
    "text": lambda v: isinstance(v, str) and bool(v.strip()),
    "flag": lambda v: isinstance(v, bool),
    "count": lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
    "seconds": lambda v: CHECKS["number"](v) and v > 0,
}


def default_config() -> dict:
    return {section: {name: f.default for name, f in fields.items()} for section, fields in SECTIONS.items()}


def read_config(path: Path) -> dict:
    """The whole document, checked; raises RuntimeError that names the first field that is missing or wrong."""
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError as fault:
        raise RuntimeError(f"no configuration at {path}; run init") from fault
    except (OSError, ValueError) as fault:
        raise RuntimeError(f"{path} cannot be read as JSON: {fault}") from fault
    if not isinstance(found, dict):
        raise RuntimeError(f"{path} is not a JSON object")
    for section, fields in SECTIONS.items():
        own = found.get(section)
        if not isinstance(own, dict):
            raise RuntimeError(f"{section} is missing")
        for name in FORBIDDEN.get(section, ()):
            if name in own:
                raise RuntimeError(f"{section}.{name} is not taken from the configuration")
        for name, field in fields.items():
            kind, optional = field.kind.removesuffix(" or null"), field.kind.endswith(" or null")
            value = own.get(name, None if optional else field.default if name == "input_mode" else ...)
            if not (optional and value is None) and not (CHECKS[kind](value) and (kind != "count" or value <= field.most)):
                raise RuntimeError(f"{section}.{name} is missing or not a {kind}" + (f" up to {field.most}" if field.most < math.inf else ""))
        if own.get("provider", LOCAL) not in (LOCAL, "openai") and not own.get("base_url"):
            raise RuntimeError(f"{section}.base_url is needed for the provider {own['provider']}")
    if found["embedding"].get("input_mode", "array") not in ("array", "string"):
        raise RuntimeError("embedding.input_mode is neither array nor string")
    return found


def _endpoint(own: dict) -> clients.Endpoint:
    return clients.Endpoint(own.get("base_url") or clients.DEFAULT_URL, own["model"], own["api_key"], float(own["timeout_seconds"]))


def text_model(config: dict, post: clients.Post = clients.post_json) -> models.TextModel:
    own = config["summary"]
    return models.EchoSummaries() if own["provider"] == LOCAL else clients.ChatSummaries(clients.ChatClient(_endpoint(own), own.get("temperature"), own.get("max_output_tokens"), post), own["concurrent_requests"])


def embedding_model(config: dict, post: clients.Post = clients.post_json) -> models.EmbeddingModel:
    own = config["embedding"]
    if own["provider"] == LOCAL:
        return models.HashedEmbeddings(own.get("dimensions") or 64)
    return clients.HttpEmbeddings(_endpoint(own), own.get("dimensions"), own["batch_size"], own.get("input_mode", "array") == "string", post)


def rerank_model(config: dict, post: clients.Post = clients.post_json) -> models.RerankModel:
    own = config["rerank"]
    return models.OverlapReranker() if own["provider"] == LOCAL else clients.HttpReranker(_endpoint(own), own["failover_enabled"], post)


def chat_client(config: dict, post: clients.Post = clients.post_json) -> clients.ChatClient | None:
    """None for the local provider: there is no stand-in that chats."""
    own = config["chat"]
    return None if own["provider"] == LOCAL else clients.ChatClient(_endpoint(own), own.get("temperature"), own.get("max_output_tokens"), post)
