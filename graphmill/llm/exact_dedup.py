"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.storage import discard, stored

FIRST_DIGIT = 24
DIGIT_GROWTH = 32
WIDEST_DIGIT = 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its group of identical texts and whether it is the row that stays.

    Texts count as their UTF-8 bytes, led by their length so that no text is a prefix of another. Round after round
    a group is split by the next bytes of its texts; a round's digit is 32 times as wide as the one before it, up to
    1 MiB. A group leaves when it holds one row or its texts have ended; equality is byte equality throughout. Only
    rows whose length and first bytes are shared carry their text past the first round. A hot group is split by
    partial aggregation and by adaptive skew joins; no task has to hold a group.

    Null text counts as empty. Of rows with the same largest id exactly one stays; a null id ranks below any other.
    Other columns are not read. An empty input gives no rows.

    Columns: id_col, keep_id, group_size, kept, text_sha256.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.octet_length(body).alias("n"), body.alias("body")
    ).withColumn("head", F.substring("body", 1, FIRST_DIGIT))
    # Tables of groups are stored before the join back, so that both its sides are plain exchanges, which adaptive
    # execution can split where a group is hot.
    shared = stored(rows.groupBy("n", "head").agg(F.count("*").alias("size"), F.max("rid").alias("gid")).filter("size > 1"), "radix-groups")
    first = stored(
        rows.join(shared, ["n", "head"], "left").select(
            "rid", "id", "n", F.sha2("body", 256).alias("sha"), "gid",
            F.when(F.col("gid").isNotNull(), F.col("body")).alias("body"),
        ),
        "radix",
    )
    discard(shared)
    outcome = first.filter("gid is null").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    live, at, width = first.filter("gid is not null"), FIRST_DIGIT, FIRST_DIGIT * DIGIT_GROWTH
    while not live.isEmpty():
        split = live.select("rid", "id", "n", "sha", "gid", "body", F.substring("body", at + 1, width).alias("digit"))
        at, width = at + width, min(width * DIGIT_GROWTH, WIDEST_DIGIT)
        groups = stored(
            split.groupBy("gid", "digit").agg(F.count("*").alias("size"), F.max("rid").alias("next_gid"), F.max(F.struct("id", "rid")).alias("best")), "radix-groups"
        )
        open_ = (F.col("size") > 1) & (F.col("n") > at)
        table = stored(
            split.join(groups, ["gid", "digit"]).select(
                "rid", "id", "n", "sha", "size", "best", open_.alias("open"), F.col("next_gid").alias("gid"),
                F.when(open_, F.col("body")).alias("body"),
            ),
            "radix",
        )
        discard(groups)
        closed = table.filter("not open").select(
            "id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), "sha"
        )
        outcome = outcome.unionByName(closed)
        live = table.filter("open")
    return outcome.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
