import json
import threading
import urllib.request

import pytest
from graphmill.config import chat_client, default_config, embedding_model, read_config, rerank_model, text_model
from graphmill.functions import clients
from graphmill.functions.clients import ChatClient, ChatSummaries, Endpoint, HttpEmbeddings, HttpReranker, ServiceError
from graphmill.functions.models import EchoSummaries, checked_scores
from graphmill.model import as_edges, as_nodes
from graphmill.plans.agent import TOOLS, Toolbox
from graphmill.sources.store import GraphStore
from graphmill.web import Service, server

END = Endpoint("https://host.example/v1/", "m", "token", 12)


class Posts:
    """Keeps what was sent; answers in turn."""

    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def __call__(self, url, headers, body, timeout):
        self.sent.append((url, headers, body, timeout))
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def said(content, **more):
    return {"choices": [{"message": {"role": "assistant", "content": content} | more}]}


def test_rerank_request_and_answer():
    post = Posts({"results": [{"index": 1, "relevance_score": 0.94}, {"index": 0, "relevance_score": 0.41}]})
    assert HttpReranker(END, True, post).score("q", ["a", "b"], 2) == [(1, 0.94), (0, 0.41)]
    url, headers, body, timeout = post.sent[0]
    assert url == "https://host.example/v1/rerank" and timeout == 12 and body == {"model": "m", "query": "q", "documents": ["a", "b"], "top_n": 2}
    assert headers == {"Authorization": "Bearer token", "Content-Type": "application/json", "X-Failover-Enabled": "true"}
    for wrong in ({}, {"results": [{"index": 2, "relevance_score": 1.0}]}, {"results": [{"index": 0, "relevance_score": "x"}]}, {"results": [{"index": True, "relevance_score": 1.0}]}, []):
        with pytest.raises(ServiceError):
            HttpReranker(END, False, Posts(wrong)).score("q", ["a", "b"], 2)


def test_embedding_requests():
    post = Posts({"data": [{"embedding": [1, 2]}, {"embedding": [3, 4.5]}]}, {"data": [{"embedding": [5, 6]}]})
    assert HttpEmbeddings(END, 2, 2, post=post).embed([" a ", "b", "c"]) == [[1, 2], [3, 4.5], [5, 6]]
    assert [x[2]["input"] for x in post.sent] == [["a", "b"], ["c"]] and post.sent[0][2]["dimensions"] == 2
    alone = Posts({"data": [{"embedding": [1.0]}]})
    assert HttpEmbeddings(END, None, 9, True, alone).embed(["a", "b"]) == [[1.0], [1.0]] and [x[2]["input"] for x in alone.sent] == ["a", "b"]
    for wrong in ({"data": []}, {"data": [{"embedding": [True]}]}, {"data": [{"embedding": []}]}, {"data": [{}]}, {}):
        with pytest.raises(ServiceError):
            HttpEmbeddings(END, 1, post=Posts(wrong)).embed(["a"])
    with pytest.raises(ValueError):
        HttpEmbeddings(END, 1, post=post).embed([" "])


def test_chat_keeps_reasoning_and_tools():
    post = Posts(said([{"text": " one "}, "two"], reasoning_content="because"))
    reply = ChatClient(END, 0.0, 9, post).reply([{"role": "assistant", "content": "x", "reasoning_content": "r"}, {"role": "user", "content": " hi "}], TOOLS)
    assert reply.text == "one\ntwo" and reply.message["reasoning_content"] == "because"
    body = post.sent[0][2]
    assert body["messages"] == [{"role": "assistant", "content": "x", "reasoning_content": "r"}, {"role": "user", "content": "hi"}]
    assert body["temperature"] == 0.0 and body["max_completion_tokens"] == 9 and [t["function"]["name"] for t in body["tools"]] == ["vector_search_seeds", "expand_neighbors", "query_relation"]
    with pytest.raises(ValueError):
        ChatClient(END, post=post).reply([{"role": "user", "content": " "}])
    for wrong in (said(" "), {"choices": []}, {}):
        with pytest.raises(ServiceError):
            ChatClient(END, post=Posts(wrong)).reply([{"role": "user", "content": "a"}])


def test_summaries_keep_their_order():
    echo = lambda url, headers, body, timeout: said("about " + body["messages"][0]["content"])
    assert ChatSummaries(ChatClient(END, post=echo), 4).generate([str(i) for i in range(40)]) == [f"about {i}" for i in range(40)]
    assert ChatSummaries(ChatClient(END, post=echo)).generate([]) == []


def test_scores_are_checked():
    assert checked_scores([(1, 0.5), (0, 1)], 2) == {0: 1.0, 1: 0.5}
    for wrong in ([(0, 1.0)], [(0, 1.0), (0, 1.0)], [(0, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError):
            checked_scores(wrong, 2)


def test_configuration(tmp_path):
    path = tmp_path / "config.json"
    good = default_config()
    assert set(good) == {"web", "graphrag", "chat", "summary", "embedding", "rerank"} and "system_prompt" not in good["chat"]

    def read(section=None, **changes):
        document = json.loads(json.dumps(good))
        if section:
            document[section] |= changes
        path.write_text(json.dumps(document))
        return read_config(path)

    assert read() == good and text_model(good) == EchoSummaries() and chat_client(good) is None
    for section, name, value in (
        ("rerank", "top_n", 0), ("rerank", "model", ""), ("rerank", "failover_enabled", "no"), ("chat", "system_prompt", "x"), ("summary", "concurrent_requests", 33), ("embedding", "batch_size", 2049), ("embedding", "input_mode", "odd"),
        ("web", "port", True), ("chat", "timeout_seconds", 0), ("embedding", "dimensions", -1), ("rerank", "provider", "other"), ("summary", "temperature", "hot"),
    ):
        with pytest.raises(RuntimeError, match=f"{section}."):
            read(section, **{name: value})
    for text in ("[]", "{", "{}"):
        path.write_text(text)
        with pytest.raises(RuntimeError):
            read_config(path)
    remote = {"provider": "other", "base_url": "https://x.example", "model": "big", "api_key": "k", "timeout_seconds": 3}
    summary = text_model(read("summary", **remote, concurrent_requests=7))
    assert summary.concurrent == 7 and summary.name == "big" and summary.chat.endpoint.timeout == 3.0
    vectors = embedding_model(read("embedding", **remote, dimensions=None, batch_size=3, input_mode="string"))
    assert (vectors.batch, vectors.single, vectors.dimensions, vectors.name) == (3, True, None, "big")
    assert rerank_model(read("rerank", **remote, failover_enabled=True)).failover and chat_client(read("chat", **remote)).endpoint.model == "big"
    assert chat_client(read("chat", provider="openai")).endpoint.base_url == clients.DEFAULT_URL


@pytest.fixture
def service(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    nodes = spark.createDataFrame([("f", "File", None, "a/F.java"), ("a", "Entity", "A", None), ("b", "Entity", "B", None)], "id string, node_type string, display_name string, relative_path string")
    edges = spark.createDataFrame([("CONTAINS", "f", "a", "m"), ("DEPENDS_ON", "a", "b", "calls")], "edge_type string, source_id string, target_id string, kind string")
    store.overwrite(as_nodes(nodes), as_edges(edges))
    return Service(store, "/r", lambda: Toolbox(spark, store, known={"a"}), lambda: {"mode": "incremental"}, config=default_config())


def test_http_reads(spark, tmp_path, service):
    assert service.answer("GET", "/api/health")[1]["status"] == "ok"
    assert service.answer("GET", "/api/summary")[1]["summary"] == {"node_count": 3, "edge_count": 2, "node_types": [{"type": "Entity", "count": 2}, {"type": "File", "count": 1}]}
    graph = service.answer("GET", "/api/graph?limit=2")[1]["graph"]
    assert {n["id"] for n in graph["nodes"]} == {"f", "a"} and [e["id"] for e in graph["edges"]] == ["CONTAINS:f:a:m"] and graph["nodes"][0]["properties"]
    assert [service.answer("GET", f"/api/graph?limit={x}")[0] for x in ("0", "x")] == [400, 422] and service.answer("GET", "/nothing")[0] == 404
    empty = Service(GraphStore(spark, f"file://{tmp_path}/none"), "/r", None, None)
    assert empty.answer("GET", "/api/summary")[0] == 404 and empty.answer("GET", "/api/health")[1]["status"] == "missing_database"


def test_http_index_is_exclusive(service):
    assert service.answer("POST", "/api/index/incremental") == (200, {"status": "success", "result": {"mode": "incremental"}})
    with service.busy:
        assert service.answer("POST", "/api/index/incremental")[0] == 409
    service.refresh = lambda: (_ for _ in ()).throw(RuntimeError("no"))
    assert service.answer("POST", "/api/index/incremental")[0] == 500 and not service.busy.locked()


def test_http_chat(service):
    ask = lambda *m: service.answer("POST", "/api/chat", json.dumps({"messages": list(m)}).encode())
    user = {"role": "user", "content": "what does a call?"}
    assert ask(user)[0] == 503
    call = {"id": "1", "function": {"name": "expand_neighbors", "arguments": json.dumps({"node_ids": ["a"], "direction": "outgoing"})}}
    post = Posts(said(None, tool_calls=[call]), said("enough"), said("a calls b"))
    service.chat = ChatClient(END, post=post)
    status, reply = ask(user)
    assert (status, reply["message"]["content"], reply["provider"]) == (200, "a calls b", "local")
    assert reply["queries"][0]["name"] == "expand_neighbors" and reply["queries"][0]["args"]["relations"][0]["neighbor"] == "b"
    assert "a:b:calls" in post.sent[1][2]["messages"][-1]["content"]
    assert [ask()[0], ask({"role": "assistant", "content": "x"})[0], ask(*[user] * 51)[0], ask({"role": "user", "content": " "})[0], service.answer("POST", "/api/chat", b"{")[0]] == [400] * 5
    service.chat = ChatClient(END, post=Posts({}))
    assert ask(user)[0] == 502


def test_http_server(service):
    with server(service, "127.0.0.1", 0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{running.server_port}/api/health") as answer:
            assert json.loads(answer.read())["status"] == "ok"
        running.shutdown()
