import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from graphmill.llm import chat, html_text, lm, mixing
from graphmill.llm.language import html_language, identify, train
from graphmill.llm.mixing import mix, mix_sql, rake
from graphmill.llm.url_filter import Rule, filter_sql, filter_urls, parse_filter_list, rule_candidates
from pyspark.sql import functions as F


# ---- language ----------------------------------------------------------------------------------------------------------

EN = "the cat and the dog went to the house with this and that of which it was"
FR = "le chat et le chien sont dans la maison avec les autres que nous avons pour vous"


def test_language_fuses_evidence(spark):
    rows = [(i, (EN if i % 2 else FR) + f" x{i}", "en" if i % 2 else "fr", "a.site.org" if i % 2 else "b.site.org") for i in range(60)]
    rows += [(100, None, "en", "a.site.org"), (101, "12 34", None, None), (102, "", "??", ""), (103, "on", "fr", "b.site.org"), (104, "on", "en-GB", "a.site.org"), (104, "on", "en-GB", "a.site.org"), (105, FR * 9000, "zz", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, e_host string")
    got = {r.doc_id: r.identified for r in identify(docs, train(docs, "text", "lang")).collect()}
    assert all(got[i].lang == ("en" if i % 2 else "fr") for i in range(60))
    assert [(got[i].lang, got[i].accepted) for i in (100, 101, 102)] == [("und", False)] * 3
    assert (got[103].lang, got[104].lang, got[105].lang) == ("fr", "en", "fr")
    empty = docs.limit(0)
    assert identify(empty, train(empty, "text", "lang")).collect() == []


def test_language_training_counts_copies_once(spark):
    rows = [(f"{EN if i % 2 else FR} x{i}", "en" if i % 2 else "fr") for i in range(20)]
    plain, copied = (train(spark.createDataFrame(r, "text string, lang string"), "text", "lang", 10**6) for r in (rows, rows + rows[:1] * 200))
    assert plain.languages == copied.languages == ["en", "fr"] and (plain.weights == copied.weights).all()


def test_rare_languages_are_modelled_in_large_tables(spark):
    many = spark.range(12000).select(F.concat(F.lit(EN + " x"), "id").alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(f"{FR} x{i}", "fr") for i in range(6)], "text string, lang string")
    assert train(many.unionByName(few), "text", "lang").languages == ["en", "fr"]


def test_markup_language_is_found_anywhere(spark):
    rows = spark.createDataFrame([("<!-- " + "x" * 9000 + " --><HTML class=a lang='de-AT'>",), ("<html>",), (None,)], "html string")
    assert [r.lang for r in rows.select(html_language("html").alias("lang")).collect()] == ["de-AT", "", None]


# ---- mixing ------------------------------------------------------------------------------------------------------------


def mixture_rows():
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["en", "en", "fr", None]), r.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(400)]
    return rows + [(400, None, None, None), (400, None, None, None), (None, "a | b", "en", "b")]


def test_mixture_equals_sql(spark):
    rows = mixture_rows()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, probability double")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT doc_id, source, lang, topic, n_tokens, probability, kept FROM ({mix_sql()})").fetchall()
    got = mix(docs, keep=["doc_id"]).select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.tokens", F.round("mix.probability", 6), "mix.kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    tokens = sum(r.tokens for r in got)
    assert abs(sum(r.tokens for r in got if r.kept) / tokens - 0.5) < 0.1
    assert mix(docs.limit(0)).collect() == []


def test_fitting_goes_on_until_marginals_are_met(spark):
    # Each source is nearly one language, so twelve cycles leave a marginal far off.
    cells = [(f"s{i}", f"l{j}", "prose", 1000 if i == j else 3) for i in range(3) for j in range(3)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    shares = {"source": [0.6, 0.3, 0.1], "lang": [0.1, 0.3, 0.6]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", x) for i, x in enumerate(v)], "value string, share double") for d, v in shares.items()}
    rows = rake(frame, targets=targets).collect()
    total = sum(r.w for r in rows)
    for d, v in shares.items():
        for i, x in enumerate(v):
            assert math.isclose(sum(r.w for r in rows if r[d] == f"{d[0]}{i}") / total, x, rel_tol=1e-5)


def test_many_cells_are_fitted_alike(spark, monkeypatch):
    # Independent marginals are met after one cycle.
    cells = [(f"s{i}", f"l{j}", f"t{k}", (i + 1) * (j + 2) * (3 * k + 1)) for i in range(3) for j in range(2) for k in range(2)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    plain = {tuple(x)[:4]: x.w for x in rake(frame, cycles=1).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    split = {tuple(x)[:4]: x.w for x in rake(frame, cycles=1).collect()}
    assert plain.keys() == split.keys() and all(math.isclose(plain[k], split[k], rel_tol=1e-9) for k in plain)


def test_mixture_replaces_its_own_column(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "own")], "doc_id long, text string, lang string, source string, mix string")
    assert mix(docs).columns == ["doc_id", "text", "lang", "source", "mix"] and mix(docs).first().mix.tokens == 2


def test_targets_that_cannot_be_met_are_reported(spark, caplog):
    frame = spark.createDataFrame([("a", "en", "prose", 10), ("b", "fr", "prose", 10)], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame([(v[0], 0.9), (v[1], 0.1)], "value string, share double") for d, v in (("source", "ab"), ("lang", ("fr", "en")))}
    assert len(rake(frame, targets=targets).collect()) == 2
    assert "can't all be met" in caplog.text


def test_mixture_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "en" if i % 4 else "fr", "a" if i % 3 else "b") for i in range(1200)], "doc_id long, text string, lang string, source string")
    half = spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double")
    got = mix(docs, targets={"lang": half}, budget=0.3).select("mix.*").collect()
    mass = Counter()
    for r in got:
        mass[r.lang] += r.probability * r.tokens
    assert math.isclose(mass["en"], mass["fr"], rel_tol=0.01)


# ---- chat --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["", None, "<|im_end|>", "\\", "\\\\<|", "<\\|", "a<", "|>", "é\n<|im_start|>user\n", "\\n"]
    rows = [(c, t, r, said[(c + t) % len(said)], "x") for c in range(10) for t, r in enumerate(["system", "user", "assistant", None, "odd\nrole\\n", "assistant"])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    got = {r.tree: r for r in chat.read_back(chat.format_chats(chat.chained(frame))).collect()}
    for c in range(10):
        own = [(r or "", t or "") for k, _, r, t, _ in rows if k == c]
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == 6 and got[c].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(chat.chained(frame.limit(0)))).collect() == []


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} <|") for t in range(20_000)]
    got = chat.read_back(chat.format_chats(chat.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first()
    learned = "".join(x for _, _, r, x in rows if r == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (20_000, len(learned), sha256(learned.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, "r", None, 1.0), (1, "a", "r", 5.0), (1, "b", "r", 1.0), (1, "a1", "a", 1.0), (1, "b1", "b", 9.0), (1, "lost", "gone", 99.0), (1, "x", "y", 9.0), (1, "y", "x", 9.0), (1, "z", "y", 9.0)]
    rows += [(2, f"n{i}", f"n{i - 1}" if i else None, None) for i in range(100)]
    frame = spark.createDataFrame(rows, "tree int, node string, parent string, score double")
    got = {}
    for r in chat.branches(frame, keep_branches=0).collect():
        got.setdefault((r.tree, r.rank, r.branch), {})[r.depth] = r.node
    paths = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert paths == {(1, 1, "b1"): ["r", "b", "b1"], (1, 2, "a1"): ["r", "a", "a1"], (2, 1, "n99"): [f"n{i}" for i in range(100)]}


# ---- html --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="ad">Buy the thing of the year</div>
<article><header><h1>Head&amp;line</h1></header><p><b>One &lt;two&gt;.<br>more<p>Short
 text</p><aside>Side the of and</aside><form>Name <input></form><div id="comments"><p>I say that this is the best of all</p></div></article>
<div class="cookie-notice">We use cookies</div><footer>&copy; x</footer>"""


@pytest.mark.parametrize(
    "html, want",
    [(PAGE, "Head&line\n\nOne <two>. more\n\nShort text"), ("", ""), ("plain", ""), ("<article>a&nbsp; b<p>c", "a b\n\nc"), ("<script>never", ""), ("<article><p>x &am", "x &am")],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_pages_without_a_container():
    long = "this is the text of the article and it is long enough to be read by all of you who are here " * 3
    html = f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Title here</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=z>more links here</a></div><p>fin</p>"
    assert html_text.main_text(html) == "\n\n".join(["Title here", long.strip(), "Short one.", long.strip()])


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "k"), (2, "u", PAGE, None), (2, "u", PAGE, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, keep=["page_id", "url"]).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, len(got[1].text), len(got[1].text)] and got[0].text == ""


# ---- url filter --------------------------------------------------------------------------------------------------------


def test_url_filter_equals_sql(spark):
    rules = [
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
        Rule("block", pattern="://[^/]*casino", literals=()), Rule("block", pattern=r"[?&]ad=1\b", literals=("ad",)),
    ]
    urls = [
        "http://example.org/en/12", "http://A.Example.ORG/es/x", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de", "x://y.com/de/?q=http://a.org/", "http://org", "http://org/",
        "no scheme casino", "a://casino.net/p", "a://b.net/?ad=1", "a://b.net/?ad=12", "", None, "http://x.com#/fr/", "://com/fr/a", "http://x.com/FR/", "http://example.org/en/1", "http://b.org/\ncom/de/",
    ]
    rows = [(i % 17, u) for i, u in enumerate(urls)] + [(1, urls[1])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({filter_sql(rules)})").fetchall()
    assert sorted(map(str, map(tuple, filter_urls(pages, rules).collect()))) == sorted(map(str, want))
    assert filter_urls(pages.limit(0), rules).collect() == []


LIST = r"""
[Adblock Plus 2.0]
! a comment
||ads.example.com^
||tracker.net/pixel*.gif|
|http://start.org/
/banner/ads-
@@||good.ads.example.com^
adserver
/^https?:..evil[0-9]+\.com/
##.ad-box
example.org##.banner
||cdn.net^$script
*^*
"""


def test_filter_list(spark):
    rules = parse_filter_list(LIST)
    assert [r.verdict for r in rules] == ["block"] * 4 + ["allow"] + ["block"] * 2
    assert [r.tokens() for r in rules] == [["ads", "example", "com"], ["tracker", "net", "gif"], ["http", "start", "org"], ["banner", "ads"], ["good", "ads", "example", "com"], [], []]
    cases = {
        "http://ads.example.com/x": "block", "https://x.ADS.example.com": "block", "http://badads.example.com/": "allow", "http://good.ads.example.com/a": "allow", "http://a.tracker.net/pixel7.gif": "block",
        "http://tracker.net/pixel7.gifx": "allow", "http://start.org/": "block", "http://x.org/?u=http://start.org/": "allow", "http://x.org/banner/ads-1": "block", "http://x.org/banner/ads": "allow",
        "http://myadservers.org/": "block", "https://evil12.com/": "block", "http://x.com/evil12.com": "allow", "": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, rules).collect()} == dict(enumerate(cases.values()))


def test_few_rules_are_tried_of_many(spark):
    r = random.Random(6)
    names = [f"site{i}" for i in range(400)]
    rules = parse_filter_list("\n".join([f"||{n}.example.{r.choice(['com', 'net'])}^" for n in names] + [f"/path{i}/{r.choice(names)}/" for i in range(400)]))
    urls = [f"http://www.{r.choice(names)}.example.{r.choice(['com', 'net'])}/path{r.randrange(400)}/{r.choice(names)}/{r.randrange(9)}" for _ in range(100)] + ["x" * 50_000, "http://" + "a/" * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want, compiled = {}, [(re.compile(x.pattern), x) for x in rules]
    for i, u in enumerate(urls):
        fit = [x for c, x in compiled if c.search(u)]
        want[i] = min(fit, key=lambda x: (-len(x.name), x.name)).verdict if fit else "allow"
    assert {x.page_id: x.verdict for x in filter_urls(pages, rules).collect()} == want and set(want.values()) == {"allow", "block"}
    assert rule_candidates(pages, rules)[1].count() / len(urls) < 10


# ---- language model ----------------------------------------------------------------------------------------------------


def brute_model(train_texts):
    """log10 probability of a text, plainly from dictionaries."""
    sents = [["</s>", *t.lower().split(), "</s>"] for t in train_texts]
    pairs = Counter(p for s in sents for p in zip(s, s[1:]))
    words = Counter(w for s in sents for w in s[1:])
    before, after = Counter(), {}
    for (v, w), n in pairs.items():
        before[w] += 1
        after.setdefault(v, []).append(n)
    d1 = lm.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    d0 = lm.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    cut = lambda n, d: max(0.0, n - (0, *d)[min(n, 3)])
    space, kinds = len(words) + 1, len(pairs)
    rest = sum((0, *d0)[min(n, 3)] for n in before.values()) / kinds

    def score(text):
        total = base = 0.0
        s = ["</s>", *text.lower().split(), "</s>"]
        for v, w in zip(s, s[1:]):
            p = cut(before[w], d0) / kinds + rest / space
            if words[v]:
                p = cut(pairs[v, w], d1) / words[v] + sum((0, *d1)[min(n, 3)] for n in after.get(v, [])) / words[v] * p
            total += math.log10(p)
            base += math.log10((words[w] + 1) / (sum(words.values()) + space))
        return total, base, len(s) - 1, sum(words[w] > 0 for w in s[1:])

    return score, sum(words.values())


def test_language_model_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["The", "cat", "dog", "é", "sat", "on"] + [f"w{i % 9}", f"u{i}"], k=r.randint(0, 40)))) for i in range(120)] + [(500, None), (500, ""), (None, "new words here"), (501, "the cat " * 20000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    held = docs.withColumn("held", lm.fold("doc_id") == 2)
    got = lm.score(held, lm.fit(held.filter("not held")), ["doc_id", "held", "text"]).collect()
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    score, n = brute_model([t or "" for i, t in rows if fold(i) != 2])
    assert len(got) == len(rows)
    for x in got:
        total, base, size, known = score(x.text or "")
        assert x.held == (fold(x.doc_id) == 2) and (x.n_tokens, x.n_known, x.train_tokens) == (size, known, n)
        assert math.isclose(x.score, total, rel_tol=1e-9) and math.isclose(x.base_score, base, rel_tol=1e-9)
    want = sorted(((x.doc_id, x.text, x.score) for x in got), key=str)
    # Buckets merged in many slices, and pairs counted beyond what the arrays hold, give the same model.
    monkeypatch.setattr(lm, "MOST_COUNT", 3)
    monkeypatch.setattr(lm, "FLUSH_ENTRIES", 50)
    model = lm.fit(held.filter("not held"), slice_bytes=16)
    assert any(p["large"] for p in model.pairs.values())
    assert sorted(((x.doc_id, x.text, x.score) for x in lm.score(held, model, ["doc_id", "text"]).collect()), key=str) == want
    empty = held.limit(0)
    assert lm.score(empty, lm.fit(empty), ["doc_id"]).collect() == []
    assert lm.score(held.limit(3), lm.fit(empty), ["doc_id"]).count() == 3
