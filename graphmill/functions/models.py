"""External models behind small protocols, with deterministic local stand-ins."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa

WORDS = re.compile(r"\w+")


class TextModel(Protocol):
    name: str

    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class EmbeddingModel(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class RerankModel(Protocol):
    def score(self, query: str, documents: Sequence[str], top_n: int) -> list[tuple[int, float]]: ...


@dataclass(frozen=True)
class EchoSummaries:
    """Gives the prompt back as the summary: its lines, joined."""

    name: str = "local-echo"

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return list(prompts)


@dataclass(frozen=True)
class HashedEmbeddings:
    """Unit vectors of signed, hashed words and word parts."""

    dimensions: int = 64
    name: str = "local-hashed"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        if not text.strip():
            raise ValueError("a blank text has no embedding")
        out = [0.0] * self.dimensions
        for word in WORDS.findall(text.lower()):
            for part in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
                h = int.from_bytes(blake2b(part.encode(), digest_size=8).digest(), "little")
                out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / size for x in out]


@dataclass(frozen=True)
class OverlapReranker:
    """Scores by the share of the query's words that a document has."""

    def score(self, query: str, documents: Sequence[str], top_n: int) -> list[tuple[int, float]]:
        wanted = set(WORDS.findall(query.lower()))
        scores = [(i, len(wanted & set(WORDS.findall(d.lower()))) / max(1, len(wanted))) for i, d in enumerate(documents)]
        return sorted(scores, key=lambda x: (-x[1], x[0]))[:top_n]


def checked_vectors(vectors: Sequence[Sequence[float]], n: int, dimensions: int | None) -> np.ndarray:
    """The vectors as one matrix, a row per text. A ragged, short or non-numeric answer makes no such matrix."""
    try:
        # Arrow infers one numeric type for all values, or fails; NumPy alone would take true for 1.
        rows = pa.array(vectors)
        kind = rows.type.value_type
        if not (pa.types.is_floating(kind) or pa.types.is_integer(kind)) or rows.flatten().null_count:
            raise ValueError(f"values of type {kind}")
        matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if dimensions is None else dimensions)
        if set(rows.value_lengths().to_pylist()) - {matrix.shape[1]}:
            raise ValueError("rows of several lengths")
        return matrix
    except (pa.ArrowException, AttributeError, TypeError, ValueError) as fault:
        raise ValueError(f"{n} vectors of {dimensions or 'equal'} dimensions were asked for: {fault}") from fault


def checked_scores(found: Sequence[tuple[int, float]], n: int) -> dict[int, float]:
    """A score for each of n texts, by its index."""
    scores = {int(i): float(s) for i, s in found}
    if len(found) != n or set(scores) != set(range(n)):
        raise ValueError(f"{len(found)} scores for {n} texts, with indexes {sorted(scores)[:5]}")
    return scores
