import random
import re

import corpus_pipeline
from graphmill.llm.simhash import near_duplicate_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def noisy(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return " ".join(out)


def test_near_duplicate_rows_against_brute_force(spark):
    r = random.Random(4)
    docs = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(150, 400))]
        docs.append(" ".join(words))
        docs += [noisy(r, words, r.choice([0, 1, 2, 3])) for _ in range(r.randint(0, 4))]
        docs.append(noisy(r, words, 60))
    docs += ["", None, " \n", "one two", "one two", "one three"]
    r.shuffle(docs)
    sets = [shingles(x) for x in docs]
    sure = [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.9]
    never = [[jaccard(sets[i], sets[j]) for j in range(len(docs)) if i != j] for i in range(len(docs))]
    frame = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(docs)], "doc_id long, text string, s_group string")
    got = {x.doc_id: x for x in near_duplicate_rows(frame).collect()}
    assert len(got) == len(docs)
    for i, j in sure:
        assert got[i].d_group == got[j].d_group
    for i, near in enumerate(never):
        if max(near) < 0.65:
            assert got[i].d_kept
    kept = [i for i in got if got[i].d_kept]
    assert len({got[i].d_group for i in got}) == len(kept)
    assert all(min(j for j in got if got[j].d_group == got[i].d_group) == i for i in kept)


def test_one_large_group(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(9000)}" for _ in range(300)]
    docs = [(i, noisy(r, words, 1)) for i in range(600)] + [(1000 + i, "same text here " * 9) for i in range(300)]
    got = near_duplicate_rows(spark.createDataFrame(docs, "doc_id long, text string")).filter("d_kept").collect()
    assert sorted(x.doc_id for x in got) == [0, 1000]


def test_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int, d_row string, d_kept string, c_row string, l_found string, mix string, found string, row string, e_host string"
    rows = [(None, None, None, None, None, None), (1, "the cat and the dog of the house", "en", None, 3, 1), (1, "the cat and the dog of the house", "en", "s", 3, 1), (2, "12 34", None, "s", 5, 2), (3, "le chat et le chien de la maison", "fr", "s", 5, 2)]
    rows = [(*x, *["own"] * 8) for x in rows]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert {x.doc_id for x in out.collect()} <= {1, 3}


def test_run_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {x.doc_id: x for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [WORD.findall(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", x.text.lower())) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {" ".join(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    frame, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        seen[name] = {x.doc_id for x in frame.collect()}
    assert len(seen["language_id"]) >= 0.97 * len(docs)
    clean = {i for i in seen["near_dedup"] if not any(f" {g} " in f" {' '.join(WORD.findall(re.sub(r'[^0-9a-z\x80-\U0010ffff]', ' ', docs[i].text.lower())))} " for g in grams)}
    assert seen["decontaminate"] == clean
    assert 0 < len(seen["mixture"]) < len(clean)
    assert {x.doc_id for x in corpus_pipeline.run(spark, sf).collect()} == seen["mixture"]
