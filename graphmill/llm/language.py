"""Language identification: text likelihood, declared language, address suffix and host prior, fused by Bayes' rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.storage import stored

#: About so many different texts of each label train the text model; every other statistic covers all rows.
TRAINING_ROWS = 4000
#: A label with fewer training rows is no language of the model.
LEAST_LABELLED = 5
DIMENSIONS = 1 << 14
CHUNK = 1 << 20
#: So many labels' counts are held by a task at a time.
MOST_HELD = 256
#: Neighbouring n-grams are far from independent: the evidence of a text counts as that of so many of them at most.
MOST_EVIDENCE = 50.0
HOST_STRENGTH = 8.0
LEAST_CONFIDENCE = 0.5
UNKNOWN = "und"
OTHER = "other"

# Letters and non-ASCII bytes stay, A-Z lowered; all else becomes a space.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def features(text: bytes):
    """Hashed byte bigrams and trigrams of the letters, a chunk at a time, so that memory is bounded for any text."""
    for at in range(0, max(1, len(text)), CHUNK):
        part = b" " + b" ".join(text[at : at + CHUNK + 2].translate(LETTERS).split()) + b" "
        a = np.frombuffer(part, np.uint8).astype(np.uint32)
        if len(a) < 3:
            continue
        pair = a[:-1] * np.uint32(0x9E3779B1) ^ a[1:] * np.uint32(0x85EBCA6B)
        three = pair[:-1] ^ a[2:] * np.uint32(0xC2B2AE35)
        yield np.concatenate([(pair * np.uint32(0x27D4EB2F)) >> np.uint32(18), (three * np.uint32(0x165667B1)) >> np.uint32(18)])


class TextModel:
    """Naive Bayes over hashed n-grams; `weights` holds log probabilities, a row per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.weights = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * DIMENSIONS)).astype(np.float32)

    def evidence(self, text: bytes) -> np.ndarray | None:
        """Log likelihoods up to a constant; None for a text without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for f in features(text):
            total += self.weights[:, f].sum(1, dtype=np.float64)
            n += len(f)
        if not n:
            return None
        return total / n * min(n / 2, MOST_EVIDENCE)


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each row."""
    e = np.exp(x - x.max(1, keepdims=True)) if x.size else x
    return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, text_col: str, lang_col: str, rows: int = TRAINING_ROWS) -> TextModel:
    """Counts n-grams of about `rows` different texts of each label (all where it has fewer), chosen by a hash of the text;
    counting runs on the executors. A label's share follows its own number of texts, so a rare language is modelled in a
    table of any size. Copies of a text count once, so a large group of copies neither outgrows the bound nor outweighs the rest."""
    import pyarrow as pa

    known = labelled.select(F.col(text_col).cast("binary").alias("body"), primary_subtag(lang_col).alias("lang")).filter("lang is not null and body is not null")
    known = known.withColumn("h", F.xxhash64("body"))
    # A row per label: two or three letters.
    share = stored(known.groupBy("lang").agg(F.least(F.lit(1.0), rows / F.approx_count_distinct("h")).alias("share")), "label-shares")
    chosen = known.join(share, "lang").filter(F.pmod("h", F.lit(1_000_000_000)) < F.col("share") * 1_000_000_000).dropDuplicates(["body", "lang"]).select("body", "lang")

    def counted(batches):
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def settled():
            for lang, own in totals.items():
                found = np.flatnonzero(own)
                # Feature -1 counts the rows.
                names, f, n = [lang] * (len(found) + 1), np.append(found, -1), np.append(own[found], seen[lang])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(f), pa.array(n)], ["lang", "f", "n"])
            totals.clear(), seen.clear()

        for batch in batches:
            for body, lang in zip(batch.column("body"), batch.column("lang").to_pylist()):
                if len(totals) >= MOST_HELD and lang not in totals:
                    yield from settled()
                own = totals.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for f in features(body.as_py()):
                    own += np.bincount(f, minlength=DIMENSIONS)
        yield from settled()

    # Rows: labels times DIMENSIONS at most.
    sums = chosen.mapInArrow(counted, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    labels, f, n = np.array(sums["lang"], object), np.array(sums["f"], np.int64), np.array(sums["n"], np.int64)
    languages = sorted(labels[(f < 0) & (n >= LEAST_LABELLED)]) or [UNKNOWN]
    counts = np.zeros((len(languages), DIMENSIONS))
    for k, language in enumerate(languages):
        own = (labels == language) & (f >= 0)
        counts[k, f[own]] = n[own]
    return TextModel(languages, counts)


def primary_subtag(column: str):
    """en of en-GB or EN_us; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.col(column).cast("string")), "^ *([a-z]{2,3})(?![a-z])", 1), F.lit(""))


def url_host(column: str):
    return F.lower(F.regexp_extract(F.col(column), "^.*?://([^/?#]*)", 1))


def url_suffix(column: str, languages: list[str]):
    """The language that an address names: a path part such as /fr/, else the top-level domain; null where neither is one."""
    part = F.lower(F.regexp_extract(F.col(column), "://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(url_host(column), r"\.([a-z]{2})$", 1)
    return F.when(part.isin(languages), part).when(top.isin(languages), top)


def html_language(column: str):
    return F.regexp_extract(F.col(column), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def identify(
    docs: DataFrame, model: TextModel, text_col: str = "text", declared: str | None = "lang", host: str | None = "source", suffix=None, keep: list[str] | None = None, out: str = "identified"
) -> DataFrame:
    """docs (columns `keep`, else all) with a struct column `out` of lang, confidence, text_lang, accepted.

    One pass over the texts scores each under the text model; the scores are stored with the columns to keep. From the
    posteriors, summed by host, declared language and suffix and combined before the shuffle, come P(declared | language),
    P(suffix | language) and host priors, smoothed towards the host's domain and that towards the whole; a hot host is
    one row of sums. The logs of all evidence are then added for each text, whose own share is left out of all these
    statistics, so that no text is evidence for itself. The host table is joined by key: Spark broadcasts it only if its
    stored size is under the session's limit, and splits a hot host's rows where it has to shuffle.

    accepted: the text has letters and the best language's probability is at least 0.5; of equally probable languages the
    first by name counts. A text without letters (null, empty, digits only) gets `und`, confidence 0. Null or unknown
    declared languages, suffixes and hosts are evidence classes of their own. Row order and repeated rows do not matter;
    an empty table gives no rows; a column named `out` is replaced by the result.
    """
    import pyarrow as pa

    languages = model.languages
    L = len(languages)
    keep = [c for c in docs.columns if c != out] if keep is None else keep
    tag = primary_subtag(declared) if declared else F.lit(None).cast("string")
    evidence = docs.select(
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
        F.col(text_col).cast("binary").alias("e_body"),
        F.when(tag.isin(languages), tag).otherwise(F.when(tag.isNull(), F.lit("")).otherwise(F.lit(OTHER))).alias("e_declared"),
        F.coalesce(suffix if suffix is not None else F.lit(None).cast("string"), F.lit("")).alias("e_suffix"),
        F.coalesce(F.col(host).cast("string") if isinstance(host, str) else host if host is not None else F.lit(""), F.lit("")).alias("e_host"),
    )
    passed = [*(f"k{i}" for i in range(len(keep))), "e_declared", "e_suffix", "e_host"]
    scores = [f"x{l}" for l in range(L)]

    def scored(batches):
        for batch in batches:
            found = np.full((batch.num_rows, L), np.nan)
            for i, body in enumerate(batch.column("e_body")):
                x = model.evidence(body.as_py() or b"")
                if x is not None:
                    found[i] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array(found[:, l]) for l in range(L))], [*passed, *scores])

    schema = T.StructType([*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), *(T.StructField(c, T.StringType()) for c in passed[len(keep) :]), *(T.StructField(c, T.DoubleType()) for c in scores)])
    rows = stored(evidence.mapInArrow(scored, schema), "language-scores")
    # A text without letters has no scores and adds nothing.
    top = F.greatest(*scores) if L > 1 else F.col("x0")
    weights = rows.filter("not isnan(x0)").select(*passed[len(keep) :], *(F.exp(F.col(c) - top).alias(c) for c in scores))
    whole = sum((F.col(c) for c in scores[1:]), F.col("x0"))
    total = [F.sum(f"p{l}").alias(f"p{l}") for l in range(L)]
    sums = stored(weights.select(*passed[len(keep) :], *((F.col(c) / whole).alias(f"p{l}") for l, c in enumerate(scores))).groupBy("e_host", "e_declared", "e_suffix").agg(*total), "language-sums")
    vector = lambda r: np.array([r[f"p{l}"] or 0.0 for l in range(L)])
    mass = vector(sums.agg(*total).first())
    base = (mass + 1) / (mass.sum() + L)
    # At most languages + 2 rows each.
    tables = {name: {r[name]: vector(r) for r in sums.groupBy(name).agg(*total).collect()} for name in ("e_declared", "e_suffix")}
    parents = F.array_join(F.slice(F.split("e_host", r"\."), -2, 2), ".")
    by_host = sums.groupBy("e_host").agg(*total).withColumn("parent", F.when(F.size(F.split("e_host", r"\.")) > 2, parents).otherwise(F.col("e_host")))
    by_parent = by_host.groupBy("parent").agg(*(F.sum(f"p{l}").alias(f"q{l}") for l in range(L)))
    priors = stored(
        by_host.join(by_parent, "parent").select("e_host", F.array(*(f"p{l}" for l in range(L))).alias("own"), F.array(*(f"q{l}" for l in range(L))).alias("domain")), "host-priors"
    )

    def fused(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in scores], 1) if n else np.empty((0, L))
            lettered = ~np.isnan(x[:, 0])
            x = np.where(lettered[:, None], x, 0.0)
            mine = softmax(x)
            # Hosts of texts without letters alone have no sums.
            own, above = (np.array([v or [0.0] * L for v in batch.column(c).to_pylist()], np.float64).reshape(n, L) for c in ("own", "domain"))
            total = x + np.log(smoothed(np.maximum(own - mine, 0), smoothed(np.maximum(above - mine, 0), base)))
            for name, table in tables.items():
                held = np.array([table.get(v, np.zeros(L)) for v in batch.column(name).to_pylist()]).reshape(n, L)
                total += np.log((np.maximum(held - mine, 0) + 0.5) / (np.maximum(mass - mine, 0) + 0.5 * max(1, len(table))))
            p = softmax(total)
            best = p.argmax(1) if n else np.empty(0, np.int64)
            sure = np.where(lettered, p[np.arange(n), best], 0.0)
            names = np.array([*languages, UNKNOWN], object)
            columns = [names[np.where(lettered, best, L)], sure, names[np.where(lettered, x.argmax(1) if n else best, L)], lettered & (sure >= LEAST_CONFIDENCE)]
            result = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.bool_()))], ["lang", "confidence", "text_lang", "accepted"])
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), result], [*(f"k{i}" for i in range(len(keep))), "found"])

    joined = rows.join(priors, "e_host", "left")
    judgement = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text_lang", T.StringType()), T.StructField("accepted", T.BooleanType())])
    schema = T.StructType([*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("found", judgement)])
    return joined.mapInArrow(fused, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("found").alias(out))


def smoothed(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Shares of the counts, drawn towards the prior as by HOST_STRENGTH texts."""
    return (counts + HOST_STRENGTH * prior) / (counts.sum(1, keepdims=True) + HOST_STRENGTH)
