import math
import random
from collections import Counter, defaultdict

from graphmill.llm import language, queries
from graphmill.llm.language import identify, train, url_suffix
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(model, rows):
    """(lang, confidence) of each (text, declared, suffix, host), every sum taken anew from all other rows."""
    L = model.languages
    post = []
    for text, *_ in rows:
        x = model.evidence(text.encode()) if text else None
        top = max(x) if x is not None else 0
        e = [math.exp(v - top) for v in x] if x is not None else [0.0] * len(L)
        post.append(([v / (sum(e) or 1) for v in e], x))
    domain = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h
    mass = [sum(p[l] for p, _ in post) for l in range(len(L))]
    base = [(m + 1) / (sum(mass) + len(L)) for m in mass]
    # Values seen on rows with letters.
    kinds = [len({r[c] for r, (_, x) in zip(rows, post) if x is not None}) for c in (1, 2)]
    out = []
    for i, (text, told, end, host) in enumerate(rows):
        mine, x = post[i]
        if x is None:
            out.append(("und", 0.0))
            continue
        others = lambda match: [max(0.0, sum(p[l] for j, (p, _) in enumerate(post) if match(rows[j])) - mine[l]) for l in range(len(L))]
        prior = base
        for counts in (others(lambda r: domain(r[3]) == domain(host)), others(lambda r: r[3] == host)):
            prior = [(c + 8 * b) / (sum(counts) + 8) for c, b in zip(counts, prior)]
        score = [v + math.log(b) for v, b in zip(x, prior)]
        for c, (value, n) in enumerate(zip((told, end), kinds), 1):
            held = others(lambda r: r[c] == value)
            score = [s + math.log((h + 0.5) / (m - p + 0.5 * n)) for s, h, m, p in zip(score, held, mass, mine)]
        e = [math.exp(s - max(score)) for s in score]
        out.append((L[e.index(max(e))], max(e) / sum(e)))
    return out


def test_fusion_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, "text", "lang")
    r = random.Random(4)
    sample = [x.text for x in docs.filter("doc_id < 60").orderBy("doc_id").collect()]
    hosts = ["a.site.org", "b.site.org", "site.org", "com", "", "www.x.y.org"]
    rows = [(t[: r.choice([3, 12, 40, 4000])] if t else t, r.choice(["en", "de", "", "other"]), r.choice(["fr", "es", ""]), r.choice(hosts)) for t in sample + [None, "", "12 34", "on", "on"]]
    frame = spark.createDataFrame([(i, t, d if d != "other" else "xx", s or None, h) for i, (t, d, s, h) in enumerate(rows)], "i int, text string, lang string, suffix string, source string")
    got = {x.i: (x.f.lang, x.f.confidence) for x in identify(frame, model, suffix=F.col("suffix"), keep=["i"], out="f").collect()}
    for i, (lang, sure) in enumerate(brute(model, rows)):
        assert got[i][0] == lang and math.isclose(got[i][1], sure, rel_tol=1e-9, abs_tol=1e-12), (i, rows[i])


def test_masked_and_wrong_labels_are_recovered(spark):
    """Held-out accuracy: a fifth of the labels is masked and a tenth is wrong, in training and as evidence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    fate = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    noisy = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(fate < 2, None).when(fate == 2, F.when(F.col("truth") == "en", "fr").otherwise("en")).otherwise(F.col("lang")))
    found = identify(noisy, train(noisy, "text", "lang"))
    counts = defaultdict(Counter)
    for x in found.select("truth", F.col("lang").alias("told"), "identified.lang").filter("lang != 'und'").collect():
        counts["masked" if x.told is None else "right" if x.told == x.truth else "wrong"][x.lang == x.truth] += 1
    accuracy = {k: c[True] / sum(c.values()) for k, c in counts.items()}
    print(accuracy)
    assert accuracy["masked"] > 0.97 and accuracy["wrong"] > 0.9 and accuracy["right"] > 0.98


def test_pages_agree_with_their_markup(spark):
    got = {x.page_id: x for x in queries.language_id_pages(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", language.html_language("html").alias("told"), url_suffix("url", ["de", "en", "es", "fr"]).alias("suffix")).collect()
    assert len(got) == len(pages)
    assert sum(got[p.page_id].lang == p.told for p in pages) / len(pages) > 0.97
    bare = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.lit(None).cast("string").alias("html"), "url")
    model = train(spark.read.parquet(f"{SF}/documents.parquet"), "text", "lang")
    none = identify(bare.withColumn("text", F.col("html")), model, declared="html", host=language.url_host("url"), keep=["page_id"]).collect()
    assert len(none) == len(pages) and not any(x.identified.accepted for x in none)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat is on it", "en", "s", 1.5, "q", "z")], "doc_id long, text string, lang string, source string, x0 double, own string, identified string")
    row = identify(docs, train(docs, "text", "lang")).first()
    # One row is too few for a language, so all letters are of the unknown one.
    assert (row.x0, row.own, row.identified.lang) == (1.5, "q", "und")
