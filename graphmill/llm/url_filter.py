"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.storage import stored

SPLIT = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule over an address. `host` fits that host and its subdomains, `path` is a prefix of the path; `pattern` is
    a regular expression over the whole address, with `literals` that any address it matches holds as whole tokens.
    A rule of host and path is `explicit` and beats pattern rules; of two of a kind the longer name wins."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()

    @property
    def explicit(self) -> bool:
        return not self.pattern

    @property
    def name(self) -> str:
        return self.pattern or f"{self.host}{self.path}"

    def tokens(self) -> list[str]:
        """Literal tokens that every address it fits has whole: the last of the path's may be cut, so it doesn't count."""
        if self.pattern:
            return [t for x in self.literals for t in re.split(SPLIT, x.lower()) if t]
        path = re.split(SPLIT, self.path.lower())
        return [t for t in re.split(SPLIT, self.host.lower()) + path[:-1] if t]


#: The production list: spam hosts, and downloads that carry no text.
SPAM_WORDS = ("casino", "farm", "pills", "spam", "win")
FILE_TYPES = ("dmg", "exe", "gif", "iso", "jpeg", "jpg", "mp4", "png", "zip")
DEFAULT_RULES = (
    *(Rule("block", pattern=rf"://[^/?#]*\b{w}\b", literals=(w,)) for w in SPAM_WORDS),
    *(Rule("block", pattern=rf"://[^/?#]*/[^?#]*\.{t}([?#]|$)", literals=(t,)) for t in FILE_TYPES),
)


#: Parts of a filter-list pattern that stand for something: a separator or the address's end, and any text.
PATTERN_PARTS = re.compile(r"(\^|\*+)")
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"


def parse_filter_list(text: str) -> list[Rule]:
    """Rules of a list in the widespread ad-block syntax, as pattern rules over whole addresses, letter case aside.

    `||` stands for the start of a host or of a part of it, `|` for the address's start or end, `^` for a separator or the
    end, `*` for any text; `/.../` is a regular expression, `@@` makes an exception that allows. Comments, headers, and
    rules for parts of pages or kinds of requests (`##`, `$`) concern no address of a page and are left out.
    """
    rules = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "![" or re.search(r"#[@?$%]?#", line):
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        if len(body) > 2 and body[0] == body[-1] == "/":
            rules.append(Rule(verdict, pattern=f"(?i){body[1:-1]}"))
            continue
        if "$" in body:
            continue
        host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
        inner = body.strip("|")
        if not inner.strip("*^"):
            continue
        pieces = [p for p in PATTERN_PARTS.split(inner) if p]
        written = "".join(SEPARATOR if p == "^" else ".*" if p[0] == "*" else re.escape(p) for p in pieces)
        pattern = "(?i)" + (r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if host else "^" if start else "") + written + ("$" if end else "")
        # A token counts only where nothing can lengthen it: something of the pattern itself bounds it on both sides.
        literals = []
        for k, piece in enumerate(pieces):
            left = pieces[k - 1] == "^" if k else host or start
            right = pieces[k + 1] == "^" if k + 1 < len(pieces) else end
            tokens = list(re.finditer("[a-z0-9]+", piece.lower())) if piece[0] not in "*^" else []
            literals += [m[0] for m in tokens if (m.start() > 0 or left) and (m.end() < len(piece) or right)]
        rules.append(Rule(verdict, pattern=pattern, literals=tuple(literals)))
    return rules


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_index(spark: SparkSession, rules: list[Rule], frequency: DataFrame) -> DataFrame:
    """Each rule with a literal, under the rarest of its literal tokens by the addresses' own token counts (unseen ones
    are rarest, ties go by the token)."""
    rows = [(k, r.name, r.verdict, r.host, r.path, r.pattern, r.explicit, len(r.name), r.tokens()) for k, r in enumerate(rules)]
    listed = spark.createDataFrame(rows, "k int, name string, verdict string, rule_host string, rule_path string, pattern string, explicit boolean, size int, tokens array<string>")
    each = listed.select("k", F.explode("tokens").alias("token"))
    ranked = each.join(frequency, "token", "left").groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return stored(listed.drop("tokens").join(ranked, "k").withColumn("token", F.col("rarest.token")).drop("k", "rarest"), "url-rules")


def fits(host, path, url, rule_host, rule_path, pattern, explicit) -> Column:
    placed = ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)
    return F.when(explicit, placed).otherwise(F.rlike(url, pattern))


def rank(explicit, size, name, verdict) -> Column:
    """The least of these is the rule that decides: explicit before pattern, long before short, then by name."""
    return F.struct((~explicit).alias("later"), (-size).alias("shorter"), name.alias("name"), verdict.alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict.

    The address's distinct tokens fetch the rules indexed under them, and only those candidates are tried. Rules
    without a literal token, which no index can serve, are tried on every address as literal expressions. Token
    counts are combined before their shuffle and only rules that fit are grouped, by row, so a hot host or token is
    never gathered; Spark broadcasts the rule table only if its stored size is under the session's limit.

    An explicit rule beats pattern rules, then the longer rule wins, then the smaller name. `rule` is the explicit rule
    that decides, else null. An address that no rule fits gets `default`; a null one, or one without ://, has an empty
    host and path. Repeated pages are judged apart; other columns are not read; empty input gives no rows.
    """
    seen, candidates = rule_candidates(pages, rules, id_col, url_col)
    tried = candidates.filter(fits(*(F.col(c) for c in ("host", "path", "url", "rule_host", "rule_path", "pattern", "explicit"))))
    best = tried.groupBy("r").agg(F.min(rank(F.col("explicit"), F.col("size"), F.col("name"), F.col("verdict"))).alias("indexed"))
    bare = [
        F.when(fits(F.col("host"), F.col("path"), F.col("url"), F.lit(r.host), F.lit(r.path), F.lit(r.pattern), F.lit(r.explicit)), rank(F.lit(r.explicit), F.lit(len(r.name)), F.lit(r.name), F.lit(r.verdict)))
        for r in rules
        if not r.tokens()
    ]
    found = F.array_min(F.array_compact(F.array("indexed", *bare)))
    decided = seen.join(best, "r", "left").select("id", "host", "path", found.alias("best"))
    return decided.select(
        F.col("id").alias(id_col), "host", "path", F.when(~F.col("best.later"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rule_candidates(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): the addresses (r, id, host, path, url), and each with the rules that its tokens fetch."""
    spark = pages.sparkSession
    rows = stored(pages.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url")), "urls")
    seen = rows.select("r", "id", host_of("url").alias("host"), path_of("url").alias("path"), "url")
    lowered = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select("r", F.explode(F.array_distinct(F.filter(F.split(lowered, SPLIT), lambda t: t != ""))).alias("token"))
    index = rule_index(spark, rules, words.groupBy("token").agg(F.count("*").alias("n")))
    # Only a row's number goes with its tokens; the address is fetched once for each rule that they find.
    return seen, words.join(index, "token").drop("token").join(seen.select("r", "host", "path", "url"), "r")


def filter_sql(rules: list[Rule], default: str = "allow") -> str:
    """The same verdicts over `pages` for DuckDB, every rule tried on every address."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    cases = {"rule": [], "verdict": []}
    for r in sorted(rules, key=lambda r: (not r.explicit, -len(r.name), r.name, r.verdict)):
        placed = f"(host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)})"
        fit = placed if r.explicit else f"regexp_matches(url, {text(r.pattern)}, 's')"
        cases["rule"].append(f"WHEN {fit} THEN {text(r.name) if r.explicit else 'NULL'}")
        cases["verdict"].append(f"WHEN {fit} THEN {text(r.verdict)}")
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {' '.join(cases['rule'])} END AS rule, CASE {' '.join(cases['verdict'])} ELSE {text(default)} END AS verdict FROM p"""
