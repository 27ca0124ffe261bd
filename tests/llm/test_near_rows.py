import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphmill.llm import simhash
from test_pipeline import jaccard, noisy, shingles


def family(r, n, changed, size=300):
    words = [f"w{r.randrange(90000)}" for _ in range(size)]
    return [" ".join(words), *(noisy(r, words, changed) for _ in range(n - 1))]


def brute_groups(texts, similarity=0.8):
    sets = [shingles(x) for x in texts]
    prints = [simhash.fingerprint_of(x.encode(), 5) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity or (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def groups(spark, texts):
    got = simhash.near_duplicate_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    least = {}
    for x in got:
        least[x.d_group] = min(least.get(x.d_group, x.doc_id), x.doc_id)
    return [least[x.d_group] for x in sorted(got, key=lambda x: x.doc_id)]


def test_links_are_decided_by_true_similarity(spark):
    # 6 to 8 changed words of 300 leave pairs between about 0.76 and 0.83.
    r = random.Random(21)
    texts = [x for _ in range(120) for x in family(r, 2, r.choice([6, 7, 8]))]
    sets = [shingles(x) for x in texts]
    near = [jaccard(sets[i], sets[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s < 0.83 for s in near) > 20 and sum(0.77 < s < 0.8 for s in near) > 20
    assert groups(spark, texts) == brute_groups(texts)


@pytest.mark.parametrize("rows", [16, 1000])
def test_large_shards_lose_no_link(spark, monkeypatch, rows):
    # Members are linked through partners of their own, not through the common text, which comes only now and then.
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    r = random.Random(33)
    texts = []
    for start in family(r, 60, 8)[1:]:
        texts += [start, noisy(r, start.split(), 4)]
    r.shuffle(texts)
    want = brute_groups(texts)
    assert len(set(want)) > 20
    assert groups(spark, texts) == want


def true_links(texts, similarity=0.8):
    """All pairs of different shingle sets with that Jaccard similarity, by a prefix index over rare shingles."""
    kept = {}
    for i, x in enumerate(texts):
        kept.setdefault(frozenset(hash(s) for s in shingles(x)), []).append(i)
    sets = list(kept)
    count = Counter(h for s in sets for h in s)
    index, pairs = defaultdict(list), set()
    for k, s in enumerate(sets):
        ordered = sorted(s, key=lambda h: (count[h], h))
        near = set()
        for h in ordered[: len(s) - math.ceil(similarity * len(s)) + 1]:
            near.update(index[h])
            index[h].append(k)
        pairs |= {(j, k) for j in near if len(s & sets[j]) >= similarity * len(s | sets[j])}
    return list(kept.values()), pairs


def test_no_link_of_the_documents_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    copies, pairs = true_links([texts[i] for i in ids])
    prints = np.array([simhash.fingerprint_of((texts[ids[c[0]]] or "").encode(), 5) for c in copies], np.uint64)
    assert len(pairs) > 40
    root = list(range(len(copies)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(len(copies)):
        pairs |= {(j, k) for j in np.flatnonzero(np.bitwise_count(prints[:k] ^ prints[k]) <= 2).tolist()}
    for j, k in pairs:
        root[find(j)] = find(k)
    want = defaultdict(set)
    for k, c in enumerate(copies):
        want[find(k)].update(ids[i] for i in c)
    got = defaultdict(set)
    for x in simhash.near_duplicate_rows(docs).select("doc_id", "d_group").collect():
        got[x.d_group].add(x.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_dense_groups_in_small_shards(spark, monkeypatch):
    # Copies of one text at about 0.75 to each other, so that most stay apart, in shards cut by the bytes of their sets.
    monkeypatch.setattr(simhash, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(simhash, "GATHERED", 500)
    r = random.Random(12)
    words = family(r, 1, 0)[0].split()
    texts = [noisy(r, words, r.choice([3, 4, 5, 6, 6, 7])) for _ in range(150)]
    want = brute_groups(texts)
    assert 20 < len(set(want)) < 140
    assert groups(spark, texts) == want


def test_texts_that_are_not_wanted_stay_where_they_are(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id) AS body")
    wanted = spark.range(0, 20_000, 40)
    got = {x.id for x in simhash.hash_filtered(rows, wanted, "id").collect()}
    assert set(range(0, 20_000, 40)) <= got and len(got) < 600
    assert simhash.hash_filtered(rows, wanted.limit(0), "id").count() == 0


def test_only_rows_with_a_candidate_get_their_sets():
    r = random.Random(8)
    texts = [*family(r, 2, 6), *family(r, 2, 6), *(x for _ in range(40) for x in family(r, 1, 0))]
    found = [simhash.sketch(x.encode(), 5) for x in texts]
    ids, n = np.arange(len(texts)), len(texts)
    mins = np.array([list(x[2]) for x in found], np.uint8)
    # The second pair is one group already. All meet in the first band.
    groups = np.array([0, 1, 2, 2, *range(4, n)])
    shard = (ids, mins, np.array([x[4] for x in found]), groups, np.zeros(n, np.int64), np.zeros(n, np.int64), [[7, *range(k * 100, k * 100 + 24)] for k in range(n)])
    assert [x.tolist() for x, _, _ in simhash.shard_candidates(*shard, 0.5)] == [[0, 1]]
