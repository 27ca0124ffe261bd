import random
import re
from hashlib import sha256

from graphmill.llm.decontaminate import contamination, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(10, len(v))
            for i in range(len(v) - k + 1) if v else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(5)
    vocab = ["the", "of", "É", "naïve", "x1", "and", "on", "to"]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(0, 25)))) for k in range(12)] + [(2, "the the"), (90, None), (91, "?!"), (10, "zeta")]
    docs = []
    for k in range(60):
        text = r.choices(vocab, k=r.randint(0, 80))
        if r.random() < 0.5:
            at = r.randint(0, len(text))
            text[at:at] = [(items[r.randrange(12)][1] or "").upper().replace(" ", ", ")]
        docs.append((k, " ".join(text)))
    return docs + [(60, None), (61, ""), (61, "Zeta"), (None, "the the"), (62, "the"), (63, "the the")], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, n_words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block_bytes in (1 << 20, 200):
        got = sorted((tuple(r) for r in contamination(d, i, block_bytes=block_bytes).collect()), key=str)
        assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d.limit(0), none.withColumnRenamed("item_id", "item_id")).collect() == []
    assert [tuple(r)[:4] for r in contamination(d, none).collect()] == [(1, 2, 0, 0)]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b y z"), (2, "b a"), (3, "a x x x b"), (4, "a"), (5, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.position) for r in proximity_matches(d.coalesce(1), ["A b", "!"], slop=3).collect()}
    assert got == {(1, 0), (2, 0)}
