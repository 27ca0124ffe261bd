import random
import re
import time
from collections import Counter

import duckdb
import pytest
from graphmill.llm import html_text
from graphmill.llm.html_text import Block

PROSE = "this is the text of the article and it is long enough to be read by all of you who are here "


def article(inner):
    return f"<nav><a href=x>Home</a></nav><article>{inner}</article><footer>the end of it</footer>"


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>Cookies are baked in an oven, and the smell of them is all over the house.</p>", "same"),
        (f"<p class=related>{PROSE}</p><div class='social links'>{PROSE}</div>", "same"),
        (f"<p>{PROSE}</p><div class=share>Share</div><div class='ad'>{PROSE}</div><div id=comments><p>{PROSE}</p></div>", PROSE.strip()),
        (f"<p>{PROSE}</p><aside>A</aside><aside>B</aside><p>Short</p><p>Shorter</p><p>{PROSE}</p>", f"{PROSE}\n\nShort\n\nShorter\n\n{PROSE}"),
        (f"<h2>Head</h2><p>{PROSE * 3}</p><ul><li><a href=a>one thing</a><li><a href=b>other</a></ul>", f"Head\n\n{PROSE * 3}"),
        ("<p>Xyzzy plugh</p>", "Xyzzy plugh"),
    ],
)
def test_parts_of_an_article(inner, want):
    want = re.sub(r"<[^>]*>", "\n\n", inner) if want == "same" else want
    assert html_text.main_text(article(inner)) == "\n\n".join(" ".join(p.split()) for p in want.split("\n\n") if p.strip())


@pytest.mark.parametrize("name", ["post comments-open", "entry-content no-sidebar", "main content"])
def test_containers_with_other_names_stay_containers(name):
    assert html_text.main_text(f"<div class='{name}'><p>Xyzzy</p></div><div class=ad>Buy</div>") == "Xyzzy"


def test_text_outside_the_declared_container_is_judged_too():
    html = f"<article><a href=x>Teaser one</a></article><article><a href=y>Teaser two</a></article><div>{PROSE * 3}</div>"
    assert html_text.main_text(html) == (PROSE * 3).strip()


@pytest.mark.parametrize("broken", ["<![foo[bar]]>", "<![ foo", "<!", "</>", "</ x>", "<p class='", '<p class="x>', "<!-- x", "<?php", "<a", "&#xFFFFFFF;", "&", "<", "\x00", "</p></b></i>"])
def test_malformed_markup(broken):
    html = article(f"<p>{PROSE}</p>")
    assert html_text.main_text(html + broken) == PROSE.strip()
    assert isinstance(html_text.main_text(broken + html), str) and isinstance(html_text.main_text(broken * 50), str)
    assert "Tail" in html_text.main_text(f"<article>{broken}<p>Tail</p>") or broken in ("<!", "<![ foo", "<p class='", '<p class="x>', "<!-- x", "<?php", "<a")


@pytest.mark.parametrize(
    "shape",
    [
        lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<div>x" * n, lambda n: "<a " * n, lambda n: '<a ="' * n,
        lambda n: "<!--" * n, lambda n: "<![a" * n, lambda n: "<" * n, lambda n: "<article>" + "<h1>x</h1>" * n, lambda n: "<script>" * n, lambda n: "<a" + " " * n + "=" * n, lambda n: "x" * n * 50,
    ],
)
def test_time_is_linear(shape):
    def spent(n):
        html, began = shape(n), time.process_time()
        html_text.main_text(html)
        return time.process_time() - began

    assert min(spent(40_000) for _ in range(2)) < 8 * max(0.1, min(spent(10_000) for _ in range(3)))


def plain_labels(blocks):
    """The rules once more, each looked up from scratch for every block."""
    firsts = []
    for b in blocks:
        letters = re.findall(r"[^\W\d_]+", b.text.lower())
        stops = len([w for w in letters if w in html_text.STOP_WORDS]) / max(1, len(letters))
        links = b.linked / max(1, len(b.text.replace(" ", "")))
        if b.shunned or links > (0.5 if b.zone else 0.33) or (b.suspect and not b.zone) or (not b.zone and len(b.text) < 200 and b.text[0] == "©"):
            firsts.append("bad")
        elif not b.heading and ((len(b.text) >= 70 and stops >= 0.3) or (len(b.text) > 200 and stops >= 0.15)):
            firsts.append("good")
        elif b.suspect or not (b.zone or b.heading or len(b.text) < 70 or stops >= 0.15):
            firsts.append("bad")
        else:
            firsts.append("short")
    out = []
    for k, b in enumerate(blocks):
        if firsts[k] != "short":
            out.append(firsts[k])
            continue
        first = next(j for j in range(k, -1, -1) if j == 0 or blocks[j - 1].zone != b.zone)
        last = next(j for j in range(k, len(blocks)) if j + 1 == len(blocks) or blocks[j + 1].zone != b.zone)
        decided = [j for j in range(first, last + 1) if firsts[j] != "short" and not (b.zone and blocks[j].shunned)]
        ahead = [j for j in decided if j > k] or ([j for j in range(k + 1, len(blocks)) if firsts[j] != "short"] if b.heading and not b.zone else [])
        if b.heading and ahead:
            out.append(firsts[ahead[0]])
            continue
        near = {firsts[j] for j in decided if abs(j - k) == min(abs(i - k) for i in decided)}
        out.append(near.pop() if len(near) == 1 else "good" if b.zone else "bad")
    return out


def test_both_passes_equal_brute_force():
    r = random.Random(5)
    for _ in range(300):
        blocks, zone = [], 0
        for _ in range(r.randint(1, 25)):
            zone = r.choice([zone, zone, zone, 0, zone + 1])
            b = Block(zone, r.random() < 0.15, r.random() < 0.1, r.random() < 0.15)
            b.text = " ".join(r.choices(["the", "of", "xyzzy", "plugh", "©", "quux"], [r.random(), 1, 2, 2, 0.2, 1], k=r.choice([1, 5, 15, 30, 60])))
            b.linked = r.choice([0, 0, 0, len(b.text) // 3, len(b.text)])
            blocks.append(b)
        html_text.label(blocks)
        assert [b.label for b in blocks] == plain_labels(blocks)


def test_pages_without_their_tags_give_nearly_the_same_text():
    """With container, menu, advert and footer tags made plain, length and density alone have to find the article."""
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    found = lost = wrong = decided = 0
    for html in pages:
        want = Counter(b for b in html_text.main_text(html).split("\n\n") if b)
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", html).replace('<div class="ad">', "<div>")
        blocks = html_text.blocks_of(bare)
        html_text.label(blocks)
        got = Counter(b.text for b in blocks if b.label == "good")
        decided += sum(html_text.first_label(b) == "short" for b in blocks)
        found, lost, wrong = found + sum((want & got).values()), lost + sum((want - got).values()), wrong + sum((got - want).values())
    assert decided > 500
    assert found / (found + lost) > 0.8 and found / (found + wrong) > 0.97


def test_long_page_and_empty_table(spark):
    page = article(f"<p>{PROSE}</p>" * 100_000)
    rows = spark.createDataFrame([(1, page, 7), (1, page, 7), (2, None, 8)], "page_id long, html string, k0 int")
    got = html_text.extract(rows).collect()
    assert sorted((r.page_id, r.k0, r.n_chars) for r in got) == [(1, 7, 100_000 * (len(PROSE) + 1) - 2)] * 2 + [(2, 8, 0)]
    assert html_text.extract(rows.limit(0)).collect() == []


def test_other_languages_are_read_by_sentences():
    story = "这是一个很长的中文段落，讲述了一个故事。" * 12
    page = f"<html><body><div><p>{story}</p></div><div class=menu><p>{'菜单。' * 40}</p></div><div><a href=x>{'链接。' * 40}</a></div></body></html>"
    assert html_text.main_text(page) == story
    polish = "Dawno temu w małym domu pod lasem mieszkał stary młynarz. Miał trzech synów, którzy pracowali razem z nim."
    assert html_text.main_text(f"<div><p>{polish}</p><p>Cena 12,99 zł Nowość</p><p>{polish}</p></div><footer>{polish}</footer>") == f"{polish}\n\nCena 12,99 zł Nowość\n\n{polish}"
    # One block in a language at hand, and function words decide again.
    assert html_text.main_text(f"<p>{polish}</p><p>It was the best of all the houses that he had been in with his family and the other man.</p>").startswith("It was")


def test_a_widget_in_an_article_has_to_read_like_prose():
    said = "The man went to the house and it was the best of all that he had seen in the world."
    assert html_text.main_text(f"<article><p class='widget-text'>{said}</p><p class='widget'>Top 10</p></article>") == said
    assert html_text.main_text(f"<div><p class='widget-text'>{said}</p></div>") == ""
