"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.storage import stored

CYCLES = 12
TEMPERATURE = 0.7
BUDGET = 0.5
FILL_ROUNDS = 8
#: Fitting goes on, CYCLES at a time, until every marginal is met up to this share of its target. Where targets can't
#: all be met, it ends once CYCLES more lower the largest error by less than STALLED of it, and the rest is logged.
TOLERANCE = 1e-6
STALLED = 1e-3
SEED = "mix-1"
#: So many cells fit one task; beyond, each step is a grouped sum and a join.
ONE_TASK_CELLS = 100_000
NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: str, words: str) -> Column:
    """A coarse topic by form: short, table, list or prose. Stands in where the table has no topic column."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.col(words) < 50, "short").when(F.instr(body, " | ") > 0, "table").when(lines * 12 > F.col(words), "list").otherwise("prose")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the row's id: 52 bits of an MD5. A null id counts as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, cycles: int = CYCLES, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (the dimensions and `tokens`) with `w`: token mass fitted to the marginal targets, of the same total.

    targets: for any dimension a table (value, share); shares are scaled to sum to one over the values present, and
    a value it lacks gets none. Without a table a value's share follows its tokens to the power `temperature`.
    Cycles are done in runs of `cycles` until the largest error of a marginal is under TOLERANCE. Targets that cannot all
    be met at once give the fit where the error stalls, exact in the last dimension as far as that can be; the error is logged.
    """
    n = cells.count()
    small = n <= ONE_TASK_CELLS
    now = cells.coalesce(1) if small else cells
    mass = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        marginal = cells.groupBy(d).agg(F.sum("tokens").alias("m"))
        wanted = marginal.withColumn("share", F.pow(F.col("m"), F.lit(temperature))) if not (targets or {}).get(d) else marginal.join(targets[d].select(F.col("value").alias(d), "share"), d, "left").fillna(0.0, ["share"])
        wanted = stored(wanted.select(d, "share"), "targets")
        whole = float(wanted.agg(F.sum("share")).first()[0] or 0)
        now = now.join(wanted.select(d, (F.col("share") * (mass / whole if whole else 0.0)).alias(f"target_{d}")), d)
    now = stored(now.withColumn("w", F.col("tokens").cast("double")), "cells")
    now = now.coalesce(1) if small else now
    error = None
    while True:
        for cycle in range(cycles):
            for d in DIMENSIONS:
                if small:
                    # One partition already: the window needs no exchange.
                    scaled = now.withColumn("held", F.sum("w").over(Window.partitionBy(d)))
                else:
                    scaled = now.join(now.groupBy(d).agg(F.sum("w").alias("held")), d)
                now = scaled.withColumn("w", F.when(F.col("held") > 0, F.col("w") * F.col(f"target_{d}") / F.col("held")).otherwise(0.0)).drop("held")
            if not small or cycle % 4 == 3 or cycle == cycles - 1:
                now = stored(now, "cells")
                now = now.coalesce(1) if small else now
        last, error = error, largest_error(now)
        if error <= TOLERANCE or cycles < 1:
            break
        if last is not None and error > last * (1 - STALLED):
            logging.getLogger(__name__).warning("targets can't all be met: a marginal stays %.3g of its target away", error)
            break
    return now.select(*DIMENSIONS, "tokens", "w")


def largest_error(cells: DataFrame) -> float:
    """The largest distance of a marginal of `w` from its target, as a share of the target."""
    errors = [
        cells.groupBy(d).agg(F.sum("w").alias("held"), F.first(f"target_{d}").alias("target")).filter("target > 0").agg(F.max(F.abs(F.col("held") / F.col("target") - 1))).first()[0]
        for d in DIMENSIONS
    ]
    return max((float(e) for e in errors if e is not None), default=0.0)


def probabilities(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """fitted with `probability`: min(1, c * w / tokens), c such that the expected tokens are `budget` of all, or as
    near as cells without mass allow. A correction may make more cells be taken whole, so they go on until none is added."""
    row = fitted.agg(F.sum("tokens"), F.sum("w")).first()
    goal = budget * float(row[0] or 0)
    c = goal / float(row[1]) if row[1] else 0.0
    whole = 0
    while True:
        full = F.col("w") * c >= F.col("tokens")
        row = fitted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full & (F.col("tokens") > 0))).first()
        if not row[1] or row[2] <= whole:
            break
        whole = row[2]
        c = (goal - float(row[0])) / float(row[1])
    return fitted.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * c / F.col("tokens"))).otherwise(F.lit(float(budget))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    keep: list[str] | None = None,
    budget: float = BUDGET,
    temperature: float = TEMPERATURE,
    cycles: int = CYCLES,
    targets: dict[str, DataFrame] | None = None,
    seed: str = SEED,
) -> DataFrame:
    """docs (columns `keep`, else all) with a struct column `mix`: source, lang, topic, tokens, probability, kept.

    Tokens are white-space words. Documents are summed by (source, lang, topic), combined before the shuffle, so a hot
    source is a few rows; the cells' mass is raked to the three marginals; a document is kept if its uniform number is
    below its cell's probability. Documents of a cell share it, and rows of one id share their fate. Null source,
    lang or topic is a value of its own; null or empty text has no tokens and is kept with the plain budget's
    probability; empty input gives no rows. The cells' table is joined back by key, and Spark broadcasts it only if
    its stored size is under the session's limit. A column named `mix` is replaced.
    """
    keep = [c for c in docs.columns if c != "mix"] if keep is None else keep
    words = F.regexp_count(F.coalesce(F.col("m_text"), F.lit("")), F.lit(WORD)).cast("long")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(id_col).alias("m_id"), F.col(text_col).alias("m_text"), value(source_col).alias("source"), value(lang_col).alias("lang"),
        *([] if topic is None else [F.coalesce(topic.cast("string"), F.lit(NONE)).alias("topic")]),
    ).withColumn("tokens", words)
    if topic is None:
        rows = rows.withColumn("topic", topic_of("m_text", "tokens"))
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = stored(probabilities(rake(cells, cycles, temperature, targets), budget), "mix").select(*DIMENSIONS, "probability")
    chosen = uniform("m_id", seed) < F.col("probability")
    return rows.join(fitted, list(DIMENSIONS)).select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.struct(*DIMENSIONS, "tokens", "probability", chosen.alias("kept")).alias("mix")
    )


def mix_sql(cycles: int = CYCLES, temperature: float = TEMPERATURE, budget: float = BUDGET, rounds: int = FILL_ROUNDS, seed: str = SEED) -> str:
    """The same mixture of `documents` as one SQL statement for DuckDB: the cycles and rounds are written out."""
    ctes = [
        rf"""w AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents)""",
        """r AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens < 50 THEN 'short' WHEN instr(text, ' | ') > 0 THEN 'table'
  WHEN (length(text) - length(replace(text, chr(10), '')) + 1) * 12 > tokens THEN 'list' ELSE 'prose' END AS topic FROM w)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"t_{d} AS (SELECT {d}, p * (SELECT sum(tokens) FROM c) / sum(p) OVER () AS target_{d} FROM (SELECT {d}, pow(sum(tokens), {temperature}) AS p FROM c GROUP BY 1))")
    ctes.append("f0 AS (SELECT c.*, tokens AS w, target_source, target_lang, target_topic FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    at = 0
    for _ in range(cycles):
        for d in DIMENSIONS:
            ctes.append(f"f{at + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * target_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM f{at})")
            at += 1
    ctes = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in ctes]
    ctes.append(f"g0 AS MATERIALIZED (SELECT {budget} * sum(tokens) / nullif(sum(w), 0) AS c FROM f{at})")
    for k in range(rounds):
        ctes.append(
            f"""g{k + 1} AS MATERIALIZED (SELECT coalesce(({budget} * sum(tokens) - sum(CASE WHEN w * c >= tokens THEN tokens ELSE 0 END))
  / nullif(sum(CASE WHEN w * c >= tokens THEN 0 ELSE w END), 0), any_value(c)) AS c FROM f{at}, g{k})"""
        )
    return f"""WITH {", ".join(ctes)},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w * c / tokens) ELSE {budget} END AS probability FROM f{at}, g{rounds})
SELECT doc_id, source, lang, topic, tokens AS n_tokens, round(probability, 6) AS probability,
  CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < probability AS kept
FROM r JOIN p USING (source, lang, topic)"""
