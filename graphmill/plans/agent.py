"""Tool calls over a stored graph, and a small loop that gathers evidence with them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphmill.functions.clients import ChatClient
from graphmill.functions.models import EmbeddingModel, HashedEmbeddings, OverlapReranker, RerankModel
from graphmill.model import VISIBLE_EDGE_TYPES
from graphmill.operators import reader, retrieval
from graphmill.operators.traversal import cut
from graphmill.sources.store import GraphStore

# How often the tools may run in one conversation.
MOST_CALLS = 6
MOST_PER_TOOL = {"vector_search_seeds": 1, "expand_neighbors": 3, "query_relation": 3}


def texts(value) -> list[str]:
    """The non-blank strings of a list, trimmed; anything else is no list."""
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else []


def direction_of(value) -> str:
    return value if value in reader.DIRECTIONS else "both"


def edge_types_of(value) -> tuple[list[str], list[str]]:
    """(visible types, warnings about others); no list means all, a list without visible ones means none."""
    if value is None:
        return list(VISIBLE_EDGE_TYPES), []
    asked = list(dict.fromkeys(texts(value)))
    return [t for t in asked if t in VISIBLE_EDGE_TYPES], [f"edge type not available: {t}" for t in asked if t not in VISIBLE_EDGE_TYPES]


@dataclass
class Toolbox:
    """The three tools. known holds the ids seen so far; with enforce, others may not be asked for, nor visited twice."""

    spark: SparkSession
    store: GraphStore
    embedding: EmbeddingModel = field(default_factory=HashedEmbeddings)
    reranker: RerankModel = field(default_factory=OverlapReranker)
    candidates_per_query: int = 20
    top_n: int = 5
    enforce: bool = True
    known: set = field(default_factory=set)
    visited: set = field(default_factory=set)

    def vector_search_seeds(self, queries: list[str], question: str | None = None) -> dict:
        asked = list(dict.fromkeys(texts(queries)))
        if not asked:
            return result("vector_search_seeds", [], ["no query"])
        nodes, edges = self.store.read()
        vectors = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.embedding.embed(asked))], "query int, vector array<double>")
        base = nodes.filter("node_type = 'Summary'")
        hits = retrieval.nearest(vectors, base, self.candidates_per_query)
        found = cut(retrieval.seed_candidates(hits, nodes, edges, self.embedding.name, self.embedding.dimensions))
        rows = retrieval.rerank(found, question or asked[0], self.reranker.score, self.top_n).collect()
        self.known |= {r.id for r in rows}
        return result("vector_search_seeds", [{"id": r.id, "type": r.type, "label": r.label, "summary": r.text, "vector_score": r.vector_score, "rerank_score": r.rerank_score} for r in rows])

    def expand_neighbors(self, node_ids: list[str], direction: str = "both", edge_types: list[str] | None = None) -> dict:
        kinds, warnings = edge_types_of(edge_types)
        return self._hops("expand_neighbors", node_ids, direction_of(direction), kinds, warnings, unvisited=True)

    def query_relation(self, node_ids: list[str], relation_type: str, direction: str = "both") -> dict:
        kinds, warnings = edge_types_of([relation_type])
        return self._hops("query_relation", node_ids, direction_of(direction), kinds, warnings, unvisited=False)

    def _hops(self, tool, node_ids, direction, kinds, warnings, unvisited) -> dict:
        asked = list(dict.fromkeys(texts(node_ids)))
        if self.enforce:
            warnings = warnings + [f"unknown node: {x}" for x in asked if x not in self.known]
            asked = [x for x in asked if x in self.known and not (unvisited and x in self.visited)]
        if not asked or not kinds:
            return result(tool, [], warnings)
        ids = self.spark.createDataFrame([(x,) for x in asked], "id string")
        hops = reader.expand(*self.store.around(ids, direction), ids, direction, tuple(kinds))
        items = [r.asDict() for r in hops.orderBy("origin", "edge_id").collect()]
        self.known |= {x["neighbor"] for x in items}
        self.visited |= set(asked)
        return result(tool, items, warnings)


#: What a model is told of the tools: names, parameters, and the values that they take.
_IDS = {"type": "array", "items": {"type": "string"}, "description": "ids of nodes seen before"}
_DIRECTION = {"type": "string", "enum": list(reader.DIRECTIONS)}
TOOLS = [
    {
        "name": name, "description": about,
        "parameters": {"type": "object", "properties": properties, "required": [k for k in properties if k not in ("direction", "edge_types")]},
    }
    for name, about, properties in (
        ("vector_search_seeds", "Finds nodes whose summaries are close to the query texts. Call it first, with two to four wordings.", {"query_texts": {"type": "array", "items": {"type": "string"}}}),
        ("expand_neighbors", "Gives the relations of known nodes that were not expanded before.", {"node_ids": _IDS, "direction": _DIRECTION, "edge_types": {"type": "array", "items": {"type": "string", "enum": list(VISIBLE_EDGE_TYPES)}}}),
        ("query_relation", "Gives the relations of one type of known nodes.", {"node_ids": _IDS, "relation_type": {"type": "string", "enum": list(VISIBLE_EDGE_TYPES)}, "direction": _DIRECTION}),
    )
]
PLAN_PROMPT = "You answer questions about a code base from its graph. Gather evidence with the tools until it is enough; then answer without calling one.\nThe graph's tables: "
ANSWER_PROMPT = "Answer the question from the evidence alone, name the nodes it rests on, and say what the evidence leaves open."


def trace(tool: str, args: dict, found: dict) -> dict:
    """What a reader of the conversation is shown of a call: its arguments as they were used, and what came of it."""
    kept = {k: v for k, v in args.items() if k in ("query_texts", "node_ids", "relation_type", "edge_types")}
    if tool != "vector_search_seeds":
        kept["direction"] = direction_of(args.get("direction"))
    kept["items" if tool == "vector_search_seeds" else "relations"] = found["items"]
    return {"name": tool, "args": kept | ({"warnings": found["warnings"]} if found["warnings"] else {})}


def result(tool: str, items: list, warnings: list | None = None) -> dict:
    return {"status": "ok", "tool": tool, "items": items, "warnings": warnings or []}


def normalized_call(call: dict) -> tuple[str, dict]:
    """(name, arguments) of a call given as name and args, or as a function with arguments in JSON."""
    inner = call.get("function") or call
    args = inner.get("args", inner.get("arguments", {}))
    if isinstance(args, str):
        args = json.loads(args) if args.strip() else {}
    return str(inner.get("name", "")), dict(args) if isinstance(args, dict) else {}


@dataclass
class ModelMind:
    """plan and answer of a Conversation by a chat model: it is shown the tables, the messages so far and the evidence."""

    client: ChatClient
    schema: str
    history: list = field(default_factory=list)
    last: str = ""

    def payload(self, evidence: list) -> str:
        return json.dumps({"evidence": evidence, "calls": len(evidence)}, sort_keys=True, ensure_ascii=False, default=str)

    def plan(self, question: str, evidence: list) -> list[dict]:
        messages = [{"role": "system", "content": PLAN_PROMPT + self.schema}, *self.history, {"role": "user", "content": question}]
        if evidence:
            messages.append({"role": "system", "content": f"Evidence so far:\n{self.payload(evidence)}"})
        reply = self.client.reply(messages, TOOLS)
        self.last = "" if reply.calls else reply.text
        return reply.calls

    def answer(self, question: str, evidence: list) -> str:
        if self.last and not evidence:
            return self.last
        return self.client.reply([{"role": "system", "content": ANSWER_PROMPT}, {"role": "user", "content": f"Question: {question}\nEvidence:\n{self.payload(evidence)}"}]).text


@dataclass
class Conversation:
    """plan(question, evidence) gives the next calls, none when done; answer(question, evidence) the reply."""

    tools: Toolbox
    plan: Callable[[str, list], list[dict]]
    answer: Callable[[str, list], str]

    def ask(self, messages: list[dict]) -> dict:
        if not messages or messages[-1].get("role") != "user" or not 1 <= len(messages) <= 50:
            raise ValueError("1 to 50 messages are needed, the last one from the user")
        if any(m.get("role") not in ("user", "assistant") or not str(m.get("content", "")).strip() for m in messages):
            raise ValueError("a message is blank, or from neither the user nor the assistant")
        question, evidence, shown, used = messages[-1]["content"].strip(), [], [], dict.fromkeys(MOST_PER_TOOL, 0)
        stop = False
        while not stop:
            calls = self.plan(question, evidence)
            if not calls:
                break
            for call in calls:
                name, args = normalized_call(call)
                if name not in used:
                    evidence.append(result(name, [], [f"unknown tool: {name}"]))
                    stop = len(evidence) > 4 * MOST_CALLS
                    continue
                if sum(used.values()) >= MOST_CALLS or used[name] >= MOST_PER_TOOL[name]:
                    # At a limit the calls still open are dropped and the answer is due.
                    stop = True
                    break
                used[name] += 1
                evidence.append(self.run(name, args, question))
                shown.append(trace(name, args, evidence[-1]))
        return {"status": "ok", "message": {"role": "assistant", "content": self.answer(question, evidence)}, "traces": evidence, "queries": shown}

    def run(self, name: str, args: dict, question: str) -> dict:
        """One call with whatever arguments the model gave: what is missing or of a wrong kind counts as empty."""
        if name == "vector_search_seeds":
            return self.tools.vector_search_seeds(args.get("query_texts", args.get("queries")), question)
        if name == "expand_neighbors":
            return self.tools.expand_neighbors(args.get("node_ids"), args.get("direction", "both"), args.get("edge_types"))
        return self.tools.query_relation(args.get("node_ids"), args.get("relation_type", ""), args.get("direction", "both"))
