"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents; the last returns the index of the token files with each document's ids read back. run() applies them in
order, each stage's rows written to the shared folder as Parquet and read again for the next.

Defined results of odd rows: a text without letters (null, empty, digits) is rejected by the first stage; repeated rows
and rows of one text are one group of the second, of which the smallest doc_id stays (null ids last); a null source is
a source of its own in the fourth; extra columns of any name pass through the first four stages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.decontaminate import contamination
from graphmill.llm.language import identify, train
from graphmill.llm.mixing import mix
from graphmill.llm.queries import END_ID, tokenizer_path
from graphmill.llm.simhash import near_duplicate_rows
from graphmill.llm.storage import discard, stored
from graphmill.llm.tokens import read_documents, write_token_files


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns p0, p1, ... and these names by the own ones, so that no column clashes with an operator's."""
    names = {c: f"p{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(n) for c, n in names.items())), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects; `lang` becomes the language found."""
    rows, n = renamed(docs)
    found = identify(rows, train(rows, n["text"], n["lang"]), n["text"], declared=n["lang"], host=n["source"], out="found").filter("found.accepted")
    return restored(found.withColumn(n["lang"], F.col("found.lang")), n)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    rows, n = renamed(docs)
    return restored(near_duplicate_rows(rows, n["doc_id"], n["text"], shingle=5, similarity=0.8).filter("d_kept"), n)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    rows, n = renamed(docs)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(rows, items, "row", n["text"])
    hit = stored(found.filter("contaminated").select("row"), "contaminated")
    discard(found.graphmill_index)
    return restored(rows.join(hit, "row", "left_anti"), n)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to the source, language and topic marginals."""
    rows, n = renamed(docs)
    return restored(mix(rows, n["doc_id"], n["text"], n["source"], n["lang"]).filter("mix.kept"), n)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them."""
    return read_documents(write_token_files(docs, tokenizer_path(), END_ID))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Language ID and near-dedup are models and sketches that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
