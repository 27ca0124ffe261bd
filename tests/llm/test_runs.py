import random
from hashlib import sha256

import numpy as np

from graphmill.llm import runs
from graphmill.llm.queries import op13_word_runs, planted
from zlib import crc32


def brute(words):
    """Every stretch that equality at a distance gives, if its smallest period is that distance."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(r):
    n, letters = r.randint(0, 150), r.choice([1, 2, 2, 3, 4, 30])
    words = [b"%d" % r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 30 else 0):
        a, p = r.randrange(n - 5), r.randint(1, 12)
        for i in range(a, a + r.randint(5, n - a)):
            words[i] = words[a + (i - a) % p]
        if r.random() < 0.3:
            words[r.randrange(n)] = b"x"
    return words


def test_refinement_finds_all_runs():
    r, total = random.Random(1), 0
    for _ in range(120):
        texts = [some_words(r) for _ in range(r.randint(0, 8))]
        want = [brute(t) for t in texts]
        assert runs.runs_in(texts) == want
        # Without leaving out what can't hold a run, too.
        held = [(t, w) for t, w in zip(texts, want) if t]
        found = runs.runs_of(np.array([int.from_bytes(x) for t, _ in held for x in t], np.int64), np.array([len(t) for t, _ in held], np.int64))
        got = [[] for _ in held]
        for k, *run in zip(*(x.tolist() for x in found)):
            got[k].append(tuple(run))
        assert got == [w for _, w in held]
        total += sum(map(len, want))
    assert total > 150


def test_long_texts_of_one_and_two_words():
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    word = [bytes([c]) for c in fib[-1][:1500]]
    assert runs.runs_in([[b"x"] * 50_000, word]) == [[(0, 50_000, 1)], brute(word)]


def damaged_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, b" ".join(some_words(r)).decode().replace(" ", r.choice([" ", "\n", " \t "])), "clash") for i in range(150)]
    rows += [(7, "again " * 40, "clash"), (200, None, None), (201, "", ""), (202, " \n\x0b", ""), (None, "z " * 30, ""), (203, "a b " * 30, ""), (10, "w " * 5000, "")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, _ in rows:
        words = damaged_words(doc_id, text)
        found = brute(words) if len(words) < 4000 else [(0, len(words), 1)]
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        short = b" ".join(w for i, w in enumerate(words) if i not in drop)
        want.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(lines.encode()).hexdigest(), sha256(short).hexdigest()))
    got = op13_word_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table_and_id_named_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.word_runs(docs).collect() == [] and planted(docs).collect() == []
    named = spark.createDataFrame([("k", "a " * 30)], "text string, body string")
    assert [tuple(x) for x in runs.word_runs(named, "text", "body").select("text", "n_words", "collapsed").collect()] == [("k", 30, "a")]
