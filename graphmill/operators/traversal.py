"""Containment closures and bounded trails."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.sources.shared import shared_folder

#: After so many levels the union of levels is stored, so that plans stay small however deep the nesting.
LEVELS_A_PLAN = 16


def _closure(seeds: DataFrame, step: DataFrame, levels_a_plan: int = LEVELS_A_PLAN) -> DataFrame:
    """(seed, id, depth) of everything reached from the seeds by step (id, next), each once at its least depth.

    Level by level: only what is new goes on, so loops end. Each level is one equi-join, stored to cut lineage.
    """
    reached = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    front = reached
    for depth in count(1):
        found = front.select("seed", "id").join(step, "id").select("seed", F.col("next").alias("id")).distinct()
        front = found.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth))
        front = cut(front)
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if depth % levels_a_plan == 0:
            reached = cut(reached)
    return reached


def reached_from(seeds: DataFrame, step: DataFrame, levels_a_plan: int = LEVELS_A_PLAN) -> DataFrame:
    """(id) of everything reached from any of the seeds by step (id, next), each once: _closure() without telling the seeds apart, so
    what several of them reach is met once."""
    reached = front = cut(seeds.select("id").distinct())
    for depth in count(1):
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(reached, "id", "left_anti"))
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if depth % levels_a_plan == 0:
            reached = cut(reached)


#: Spark's setting that ends an execution's shuffle files with it, instead of when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and cut off from its lineage: written to the shared folder and read again. Nothing reads its shuffles after that, so they
    go at once."""
    spark = df.sparkSession
    where, before = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(where)
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(where)


def contains(edges: DataFrame, up: bool = False) -> DataFrame:
    held = edges.filter(F.col("edge_type") == "CONTAINS")
    a, b = ("target_id", "source_id") if up else ("source_id", "target_id")
    return held.select(F.col(a).alias("id"), F.col(b).alias("next"))


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) down the containment tree, the seed itself included."""
    return _closure(seeds, contains(edges))


def ancestors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) up the tree: repositories, modules and files only."""
    kept = nodes.filter(F.col("node_type").isin("Repository", "Module", "File")).select("id")
    return _closure(seeds, contains(edges, up=True)).join(kept, "id", "left_semi").select("seed", "id", "depth")


def source_files_of(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id): the nearest file at or above each seed; seeds without one have no row."""
    up = _closure(seeds, contains(edges, up=True))
    files = nodes.filter(F.col("node_type") == "File").select("id")
    return up.join(files, "id", "left_semi").groupBy("seed").agg(F.min(F.struct("depth", "id")).alias("nearest")).select("seed", F.col("nearest.id").alias("id"))


def useful_pairs(edges: DataFrame, sources: DataFrame, ends: DataFrame, max_depth: int) -> DataFrame:
    """(a, b, left): hashes of both ends of the edges that a trail of max_depth edges can have, and the fewest edges from b to a target.

    First forward from the sources, which mostly are few, then back from the targets over what that has left. Both go by 64-bit
    hashes, a few bytes an edge however long ids are; two ids of one hash leave an edge too many here, and none too few.
    """
    pairs = edges.select(F.xxhash64("source_id").alias("a"), F.xxhash64("target_id").alias("b"))
    seen = front = cut(sources.select(F.xxhash64("id").alias("node")).distinct())
    begun = []
    for depth in range(max_depth):
        begun.append(cut(pairs.join(front.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b", F.lit(depth).alias("depth"))))
        front = cut(begun[-1].select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    begun = reduce(DataFrame.unionByName, begun)
    seen = front = cut(ends.select(F.xxhash64("target_id").alias("node")).distinct())
    found = []
    for left in range(max_depth):
        back = begun.filter(F.col("depth") + 1 + left <= max_depth).join(front.withColumnRenamed("node", "b"), "b", "left_semi")
        found.append(cut(back.select("a", "b", F.lit(left).alias("left")).distinct()))
        front = cut(found[-1].select(F.col("a").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, found)


def trails(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int, limit: int | None = None) -> DataFrame:
    """(source_id, target_id, depth, path, edge_ids): directed trails of 1 to max_depth edges; no edge occurs twice in one.

    One equi-join per level, over the edges that a source reaches and that still can reach a target, which useful_pairs() finds first. With a
    limit the first trails by depth, path and edges are given, and no level is entered after those before it have given enough.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    # Each level reads the level before it, so levels are cut off: the plan stays as small as one level.
    edges = cut(edges.select("id", "source_id", "target_id"))
    ends = cut(targets.select(F.col("id").alias("target_id")).distinct())
    pairs = useful_pairs(edges, sources, ends, max_depth)
    useful = cut(edges.withColumns({"a": F.xxhash64("source_id"), "b": F.xxhash64("target_id")}).join(pairs, ["a", "b"]).select("id", "source_id", "target_id", "left"))
    walk = sources.select(F.col("id").alias("source_id"), F.col("id").alias("at"), F.col("id").alias("path"), F.array().cast("array<string>").alias("seen")).distinct()
    found, n = [], 0
    for depth in range(1, max_depth + 1):
        step = useful.filter(F.col("left") <= max_depth - depth).select(F.col("id").alias("edge"), F.col("source_id").alias("at"), F.col("target_id").alias("to"))
        walk = walk.join(step, "at").filter(~F.array_contains("seen", F.col("edge")))
        walk = cut(walk.select("source_id", F.col("to").alias("at"), F.concat_ws(">", "path", "to").alias("path"), F.array_append("seen", F.col("edge")).alias("seen")))
        found.append(walk.join(ends, F.col("at") == F.col("target_id"), "left_semi").withColumn("depth", F.lit(depth)))
        if limit is not None and (n := n + found[-1].limit(limit).count()) >= limit:
            break
    out = reduce(DataFrame.unionByName, found).select("source_id", F.col("at").alias("target_id"), "depth", "path", F.array_join("seen", "|").alias("edge_ids"))
    return out if limit is None else out.orderBy("depth", "path", "edge_ids").limit(limit)
