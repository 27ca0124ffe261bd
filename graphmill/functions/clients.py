"""Clients of model services that speak the widespread JSON protocols for chat, embeddings and reranking.

Each takes `post`, a function that sends a JSON document and gives the answer's, so that tests and other transports can
stand in. All are plain picklable values: executors make requests with their own copy.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

from graphmill.functions.models import checked_vectors

Post = Callable[[str, dict, dict, float], dict]
DEFAULT_URL = "https://api.openai.com/v1"


class ServiceError(RuntimeError):
    """A model service could not be reached, or gave an answer that cannot be used."""


def post_json(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError) as fault:
        raise ServiceError(f"{url}: {fault}") from fault


@dataclass(frozen=True)
class Endpoint:
    base_url: str
    model: str
    api_key: str
    timeout: float = 60.0

    def ask(self, post: Post, path: str, body: dict, **headers: str) -> dict:
        sent = {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"} | headers
        answer = post(f"{self.base_url.rstrip('/')}/{path}", sent, {"model": self.model} | body, self.timeout)
        if not isinstance(answer, dict):
            raise ServiceError(f"{path}: the answer is no JSON object")
        return answer


@dataclass(frozen=True)
class Reply:
    text: str
    calls: list[dict] = field(default_factory=list)
    #: The message as it goes back into the conversation, with its reasoning where the model gave some.
    message: dict = field(default_factory=dict)


def text_of(content) -> str:
    """The text of a message's content, which is a string or a list of parts."""
    parts = content if isinstance(content, list) else [content]
    found = (p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in parts)
    return "\n".join(t.strip() for t in found if isinstance(t, str) and t.strip())


@dataclass(frozen=True)
class ChatClient:
    endpoint: Endpoint
    temperature: float | None = None
    max_output_tokens: int | None = None
    post: Post = post_json

    def reply(self, messages: Sequence[dict], tools: Sequence[dict] = ()) -> Reply:
        """The model's next message. What goes in keeps its fields, reasoning included; a blank message is refused."""
        if any(not text_of(m.get("content")) and not m.get("tool_calls") for m in messages):
            raise ValueError("a message is blank")
        body: dict = {"messages": [m | {"content": text_of(m.get("content"))} for m in messages]}
        body |= {"temperature": self.temperature} if self.temperature is not None else {}
        body |= {"max_completion_tokens": self.max_output_tokens} if self.max_output_tokens is not None else {}
        body |= {"tools": [{"type": "function", "function": t} for t in tools]} if tools else {}
        try:
            message = self.endpoint.ask(self.post, "chat/completions", body)["choices"][0]["message"]
        except (KeyError, IndexError, TypeError) as fault:
            raise ServiceError("the answer holds no message") from fault
        calls = message.get("tool_calls") or []
        kept = {k: message[k] for k in ("content", "tool_calls", "reasoning_content") if message.get(k)}
        reply = Reply(text_of(message.get("content")), calls, {"role": "assistant", "content": ""} | kept)
        if not reply.text and not calls:
            raise ServiceError("the answer holds no text")
        return reply


@dataclass(frozen=True)
class ChatSummaries:
    """Summaries by a chat model, at most `concurrent` requests at a time, in the order of the prompts."""

    chat: ChatClient
    concurrent: int = 10

    @property
    def name(self) -> str:
        return self.chat.endpoint.model

    def generate(self, prompts: Sequence[str]) -> list[str]:
        with ThreadPoolExecutor(max(1, min(self.concurrent, 32, len(prompts)))) as pool:
            return list(pool.map(lambda p: self.chat.reply([{"role": "user", "content": p}]).text, prompts))


@dataclass(frozen=True)
class HttpEmbeddings:
    """Vectors from a service, in requests of at most `batch` texts, or one text each as a plain string with `single`."""

    endpoint: Endpoint
    dimensions: int | None = None
    batch: int = 25
    single: bool = False
    post: Post = post_json

    @property
    def name(self) -> str:
        return self.endpoint.model

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        asked = [t.strip() for t in texts]
        if not all(asked):
            raise ValueError("a blank text has no embedding")
        size = 1 if self.single else min(self.batch, 2048)
        parts = [self._request(asked[at : at + size]) for at in range(0, len(asked), size)]
        return np.concatenate(parts).tolist() if parts else []

    def _request(self, texts: list[str]) -> np.ndarray:
        body = {"input": texts[0] if self.single else texts, "encoding_format": "float"} | ({"dimensions": self.dimensions} if self.dimensions else {})
        try:
            vectors = [item["embedding"] for item in self.endpoint.ask(self.post, "embeddings", body)["data"]]
            return checked_vectors(vectors, len(texts), self.dimensions)
        except (KeyError, TypeError, ValueError) as fault:
            raise ServiceError(f"the answer holds no vectors for {len(texts)} texts: {fault}") from fault


@dataclass(frozen=True)
class HttpReranker:
    """Scores from a cross-encoder service: (index, score) of the best documents."""

    endpoint: Endpoint
    failover: bool = False
    post: Post = post_json

    def score(self, query: str, documents: Sequence[str], top_n: int) -> list[tuple[int, float]]:
        body = {"query": query, "documents": list(documents), "top_n": top_n}
        answer = self.endpoint.ask(self.post, "rerank", body, **{"X-Failover-Enabled": str(self.failover).lower()})
        try:
            found = [(r["index"], r["relevance_score"]) for r in answer["results"]]
        except (KeyError, TypeError) as fault:
            raise ServiceError("the answer holds no results") from fault
        for index, score in found:
            if type(index) is not int or not 0 <= index < len(documents) or type(score) not in (int, float):
                raise ServiceError(f"no score of a document: {index!r}, {score!r}")
        return [(index, float(score)) for index, score in found]
