"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words of the languages at hand.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his i if in into is it its
    more not of on one or other our out she so some than that the their them then there these they this to was we were
    what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me
    même mes mon ne nos notre nous on ou où par pas pour qu que qui sa sans se ses son sont sur ta te tu un une vos votre vous
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die dies du durch ein eine einem einen einer
    es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder ohne sein sich sie sind so über um und uns unter vom von
    vor war was wenn wer wie wir wird zu zum zur
    al algo como con cuando de del desde donde dos el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hay la las
    le les lo los más me mi muy nada ni no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene un una
    uno y ya""".split()
)
# Elements that start and end a block, that hold no text for readers, whose content is no markup, that
# have no content, and that are never the article.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section
    select summary table tbody td tfoot th thead title tr ul""".split()
)
SILENT_TAGS = frozenset("applet audio canvas embed head iframe map math noscript object script style svg template title video".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("aside button dialog footer form header menu nav search select textarea".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class names and ids. The first name what a page's article is in and may stand beside; the
# second what is never the article; the third what may be part of it, so that a block of it must read like prose.
CONTENT_WORDS = frozenset("article content entry main post story".split())
CONTENT_COMPANY = CONTENT_WORDS | frozenset("area blog body container inner page single text wrap wrapper".split())
BOILERPLATE_WORDS = frozenset(
    """ad ads adsense advert advertisement adverts banner bottombar breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay
    pager pagination popup promo promoted promotion recommended replies respond sidebar signup sponsor sponsored subscribe
    subscription toolbar topbar""".split()
)
SUSPECT_WORDS = frozenset("alert disclaimer header links login related reply search share sharing skip social tags teaser warning widget".split())
#: An element of the first kind ends when one of its own starts, unless a list or table has begun in between.
CLOSED_BY = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
WALLS = ("ul", "ol", "table", "dl", "select")

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
MOST_LINKS, MOST_LINKS_INSIDE = 0.33, 0.5
LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"[a-z]+")
#: Marks that end sentences in many scripts, and scripts that are written without spaces.
SENTENCE_MARK = re.compile("[.!?…。！？｡؟۔।॥።]")
DENSE_SCRIPTS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

# A comment, a declaration, or a tag and its attributes. No alternative gives back what it has read, and a tag that never
# ends reads the rest of the page, so any page is read in linear time.
MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?--!?>|.*+)|[!?][^>]*+>?|/(?![A-Za-z])[^>]*+>?|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<said>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?P<shut>>?))""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
SAYING = re.compile("class|id|role|hidden|style", re.IGNORECASE)


class Block:
    """A run of text between block elements. `shunned`: in an element that is never the article; `suspect`: in one that
    may be; `zone`: the content container it is in, 0 outside of any."""

    __slots__ = ("heading", "label", "linked", "parts", "shunned", "suspect", "text", "zone")

    def __init__(self, zone: int, shunned: bool, suspect: bool, heading: bool):
        self.parts, self.linked, self.text, self.label = [], 0, "", ""
        self.zone, self.shunned, self.suspect, self.heading = zone, shunned, suspect, heading


def named(said: dict) -> tuple[bool, bool, bool]:
    """(names a content container, names what is never the article, names what may be) from an element's class and id."""
    content = never = maybe = False
    for token in f"{said.get('class', '')} {said.get('id', '')}".lower().split():
        words = set(WORDS.findall(token))
        content |= bool(words & CONTENT_WORDS) and words <= CONTENT_COMPANY
        never |= bool(words & BOILERPLATE_WORDS)
        # entry-header or post-tags are parts of the article.
        maybe |= bool(words & SUSPECT_WORDS) and not words & CONTENT_WORDS
    return content, never, maybe


class Cutter:
    """Cuts a page into blocks. Every open element is pushed and popped once, and the innermost element of a name is
    found by its own stack, so the work is linear in the page, however deep or broken its markup."""

    def __init__(self):
        self.blocks: list[Block] = []
        #: Of the open elements: (tag, silent, shunned, suspect, zone)
        self.open: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.zones, self.fresh = 0, True

    def innermost(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def cut(self, k: int) -> None:
        for x in self.open[k:]:
            self.places[x[0]].pop()
        del self.open[k:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        if tag in BLOCK_TAGS:
            self.fresh = True
            if self.innermost("p"):
                self.cut(self.innermost("p"))
            wall = max(map(self.innermost, WALLS)) if tag in CLOSED_BY else 0
            for other in CLOSED_BY.get(tag, ()):
                if self.innermost(other) > wall:
                    self.cut(self.innermost(other))
        if tag in VOID_TAGS:
            return
        _, silent, shunned, suspect, zone = self.open[-1]
        said = {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))} if SAYING.search(attributes) else {}
        content, never, maybe = named(said) if "class" in said or "id" in said else (False, False, False)
        role = said.get("role", "").strip().lower()
        content = tag in ("article", "main") or role in ("main", "article") or (content and tag in ("div", "section", "td"))
        if tag in ("html", "body"):
            content = never = maybe = False
        elif content and not zone:
            never = never and not (named(said)[0] or tag == "main" or role == "main")
            maybe = False
        never = never or role in BOILERPLATE_ROLES or (tag in BOILERPLATE_TAGS and not (tag == "header" and zone))
        if content and not zone and not (never or shunned or silent):
            self.zones += 1
            zone = self.zones
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in "".join(said.get("style", "").split()).lower()
        self.places[tag].append(len(self.open))
        self.open.append((tag, silent or hidden or tag in SILENT_TAGS, shunned or never, suspect or maybe, zone))

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.fresh = True
        if self.innermost(tag):
            self.cut(self.innermost(tag))

    def text(self, data: str) -> None:
        _, silent, shunned, suspect, zone = self.open[-1]
        if silent or (self.fresh and not data.strip()):
            return
        if self.fresh:
            self.blocks.append(Block(zone, shunned, suspect, any(x[0] in HEADINGS for x in self.open[-4:])))
            self.fresh = False
        self.blocks[-1].parts.append(data)
        if self.innermost("a"):
            self.blocks[-1].linked += len("".join(data.split()))


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text, in order. Malformed markup never fails: what starts like a comment, declaration or tag and
    has no end reads on to the page's end, and any other `<` is text."""
    cutter, at = Cutter(), 0
    while (m := MARKUP.search(html, at)) is not None:
        if m.start() > at:
            cutter.text(unescape(html[at : m.start()]))
        at = m.end()
        if not m["tag"] or not m["shut"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            cutter.end(tag)
            continue
        cutter.start(tag, m["said"])
        if m["said"].endswith("/") and tag not in VOID_TAGS:
            cutter.end(tag)
        elif tag in RAW_TAGS:
            close = re.compile(f"</{tag}(?![^\\s/>])", re.IGNORECASE).search(html, at)
            if close is None:
                return finished(cutter.blocks)
            at = close.start()
    if at < len(html):
        cutter.text(unescape(html[at:]))
    return finished(cutter.blocks)


def finished(blocks: list[Block]) -> list[Block]:
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def reads_known(blocks: list[Block]) -> bool:
    """Whether any block of some length has the function words of a language at hand; else they say nothing about the page."""
    return any(not b.shunned and len(b.text) >= SHORT and stop_density(b.text) >= STOP_LOW for b in blocks)


def first_label(block: Block, known: bool = True) -> str:
    """good, bad or short, by the block's link density, length and stop-word density. What its elements say shifts the
    rules: an element that is never the article is bad, a suspect one must read like prose, and in a content container
    text without stop words is left to its neighbours. Where the page's language is not known, sentence marks stand in for stop words,
    and letters of scripts that need no spaces count threefold."""
    text, inside = block.text, bool(block.zone)
    links = block.linked / max(1, len(text.replace(" ", "")))
    if block.shunned or links > (MOST_LINKS_INSIDE if inside else MOST_LINKS) or (block.suspect and not inside):
        return "bad"
    if not inside and len(text) < LONG and text.startswith("©"):
        return "bad"
    stops = stop_density(text)
    if not known:
        size = len(text) + 2 * len(DENSE_SCRIPTS.findall(text))
        if not block.heading and size >= SHORT and SENTENCE_MARK.search(text):
            return "good"
        return "bad" if block.suspect else "short" if inside or block.heading or size < SHORT else "bad"
    prose = not block.heading and len(text) >= SHORT and (stops >= STOP_HIGH or (stops >= STOP_LOW and len(text) > LONG))
    if prose:
        return "good"
    if block.suspect:
        return "bad"
    return "short" if inside or block.heading or len(text) < SHORT or stops >= STOP_LOW else "bad"


def label(blocks: list[Block]) -> None:
    """Both passes. A short block takes the label of its nearest decided neighbour in its zone: a run of blocks in one
    content container, or outside of any. In a container, blocks of elements that are never the article are passed over.
    Of two at equal distance that differ, the good one counts in a container, the bad one outside. A heading belongs to
    what follows it, in any zone. A short block without a decided neighbour is good in a container, else bad."""
    known = reads_known(blocks)
    firsts = [first_label(b, known) for b in blocks]
    n = len(blocks)

    def neighbours(order):
        """For each block the nearest decided one in that direction, in its zone and anywhere; -1 for none."""
        near, any_, last, far = [-1] * n, [-1] * n, -1, -1
        zone = None
        for k in order:
            if blocks[k].zone != zone:
                zone, last = blocks[k].zone, -1
            near[k], any_[k] = last, far
            if firsts[k] != "short" and not (blocks[k].shunned and zone):
                last = k
            if firsts[k] != "short":
                far = k
        return near, any_

    (before, _), (after, following) = neighbours(range(n)), neighbours(range(n - 1, -1, -1))
    for k, b in enumerate(blocks):
        b.label = firsts[k]
        if b.label != "short":
            continue
        ahead = after[k] if after[k] >= 0 else following[k] if b.heading and not b.zone else -1
        if b.heading and ahead >= 0:
            b.label = firsts[ahead]
            continue
        found = [(abs(k - j), (firsts[j] == "good") != bool(b.zone), firsts[j]) for j in (before[k], after[k]) if j >= 0]
        b.label = min(found)[2] if found else "good" if b.zone else "bad"


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    label(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (columns `keep`, else all but html_col) with the page's main text in `out`, and n_chars.

    Pass one labels each block good, bad or short by its link density, length and density of function words. Menus,
    headers, footers, asides, forms and blocks whose class, id or role names such a thing or adverts, notices or comments
    are bad. Pass two gives short blocks the label of their nearest decided neighbours. A declared content container
    (article, main or the like) is one zone of neighbours, and eases the rules for what is in it.

    Null or empty html gives an empty text; so does an empty table no rows. Malformed, deep and very long pages are read
    in linear time, each whole and apart from others; repeated rows get equal results. A kept column named like an
    output gives two columns of that name, as a select would.
    """
    import pyarrow as pa

    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def texts(batches):
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    schema = T.StructType([*(T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(texts, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("text").alias(out), "n_chars")
