"""Pre-order interval labels of the containment forest, and closures that are one range join with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.operators.intervals import dyadic_pairs
from graphmill.operators.traversal import contains, cut

LABELS = T.StructType([T.StructField("id", T.StringType()), T.StructField("root", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("first", "last", "depth")])


def siblings(children: DataFrame) -> DataFrame:
    """(parent, id, sibling): each child with the next one of its parent in order of id, null for the last.

    The rows are sorted by range of (parent, id), so a parent of very many children fills several files. Within a file the next row is a
    window's, and the first row of the next file is found among one row a file.
    """
    parts = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(children.select("parent", "id").repartitionByRange(parts, "parent", "id").withColumn("part", F.spark_partition_id()))
    heads = placed.groupBy("part").agg(F.min(F.struct("parent", "id")).alias("head")).withColumn("after", F.lead("head").over(Window.orderBy("part")))
    following = F.lead(F.struct("parent", "id")).over(Window.partitionBy("part").orderBy("parent", "id"))
    found = placed.withColumn("following", following).join(heads.select("part", "after"), "part").withColumn("following", F.coalesce("following", "after"))
    return found.select("parent", "id", F.when(F.col("following.parent") == F.col("parent"), F.col("following.id")).alias("sibling"))


def tour(children: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, side, next_node, next_side, weight): the Euler tours of a forest (parent, id) as linked lists, side 0 where a node is entered and
    1 where it is left. weights: id, weight, of at least the nodes of the forest."""
    first = children.groupBy("parent").agg(F.min("id").alias("child")).withColumnRenamed("parent", "id")
    nodes = children.select("id").unionByName(children.select(F.col("parent").alias("id"))).distinct().join(weights, "id")
    enter = nodes.join(first, "id", "left").select(F.col("id").alias("node"), F.lit(0).alias("side"), F.coalesce("child", "id").alias("next_node"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_side"), "weight")
    after = siblings(children).select("id", F.coalesce("sibling", "parent").alias("next_node"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("next_side"))
    return enter.unionByName(nodes.join(after, "id", "left").select(F.col("id").alias("node"), F.lit(1).alias("side"), "next_node", "next_side", "weight"))


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """leaves (parent, id, weight) with `before`, the weight of those of the same parent that come before it by id; stored.

    Sorted by range of (parent, id) as in siblings(): a running sum within each part, and for a parent in several parts what the parts before
    it have of that parent.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(leaves.repartitionByRange(parts, "parent", "id").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("parent", "part").agg(F.sum("weight").alias("held")).withColumn("carried", F.sum("held").over(earlier)).filter("carried is not null")
    running = Window.partitionBy("part", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("running", F.coalesce(F.sum("weight").over(running), F.lit(0)))
    return cut(summed.join(carried.select("parent", "part", "carried"), ["parent", "part"], "left").select("parent", "id", "weight", (F.col("running") + F.coalesce("carried", F.lit(0))).alias("before")))


def forest_labels(edges: DataFrame) -> DataFrame | None:
    """(id, root, first, last, depth) of each node of the containment forest: what lies below a node, itself included, are the nodes of its
    root with `first` in its [first, last]. None where the edges are no forest (a node with two parents, or a loop).

    While at least half of the nodes are children of parents that have leaves alone, these are taken off, each noting how far behind its parent's
    number its own will be, and parents take over their weight; so all such rounds together move a few rows a node, and shallow forests
    need no others. What is left is ranked by core_labels(), then the leaves get their numbers, last ones first.
    """
    children = cut(contains(edges).select(F.col("id").alias("parent"), F.col("next").alias("id")).filter("parent is not null and id is not null").distinct())
    if not children.groupBy("id").count().filter("count > 1").isEmpty():
        return None
    one = F.lit(1).cast("long").alias("weight")
    weights = cut(children.select("id").unionByName(children.select(F.col("parent").alias("id"))).distinct().select("id", one))
    taken = []
    while n := children.count():
        inner = children.join(children.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select("parent").distinct()
        bare = children.join(inner, "parent", "left_anti")
        leaves = placed_leaves(bare.join(weights, "id").select("parent", "id", "weight"))
        if 2 * leaves.count() < n:
            break
        above = weights.select(F.col("id").alias("parent"), F.col("weight").alias("own"))
        taken.append(cut(leaves.join(above, "parent").select("parent", "id", "weight", (F.col("own") + F.col("before")).alias("behind"))))
        more = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("weight").alias("more"))
        left = weights.join(leaves.select("id"), "id", "left_anti").join(more, "id", "left")
        weights = cut(left.select("id", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")))
        children = cut(children.join(leaves.select("id"), "id", "left_anti").select("parent", "id"))
    core = core_labels(children, weights)
    if core is None:
        return None
    alone = weights.join(core.select("id"), "id", "left_anti")
    alone = alone.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("first"), (F.col("weight") - 1).alias("last"), F.lit(0).cast("long").alias("depth"))
    parts = [cut(core.unionByName(alone))]
    # A leaf's parent has been taken off in a later round, or is in the core.
    for leaves in reversed(taken):
        held = reduce(DataFrame.unionByName, parts).select(F.col("id").alias("parent"), "root", F.col("first").alias("at"), "depth")
        first = F.col("at") + F.col("behind")
        parts.append(cut(leaves.join(held, "parent").select("id", "root", first.alias("first"), (first + F.col("weight") - 1).alias("last"), (F.col("depth") + 1).alias("depth"))))
    return reduce(DataFrame.unionByName, parts)


def core_labels(children: DataFrame, weights: DataFrame) -> DataFrame | None:
    """forest_labels() of the forest (parent, id) whose nodes stand for as many numbers as their weight (id, weight); None where it has a loop.

    The tours are ranked by pointer doubling: in each round a place adds up what the place it points at has added up, and points where that
    one points. That takes log2 of the longest tour in rounds, however deep the forest is; every join is on a place, of which there is one
    row, so no parent of many children is gathered. Only places that are not at their list's end go into a round.
    """
    # entered: weight of entries from a place to its list's end; level: entries less exits. Both leave out the place that is pointed at and what is after it.
    state = cut(tour(children, weights).select("node", "side", "next_node", "next_side", F.when(F.col("side") == 0, F.col("weight")).otherwise(0).alias("entered"), (1 - 2 * F.col("side")).cast("long").alias("level"), F.when(F.col("next_node").isNull(), F.col("node")).alias("root")))
    there = [F.col(c).alias(f"there_{c}") for c in ("next_node", "next_side", "entered", "level", "root")]
    before = None
    while n := (going := state.filter("root is null")).count():
        # A list that has an end gets shorter in every round; what does not is a loop.
        if n == before:
            return None
        before = n
        ahead = state.select(F.col("node").alias("next_node"), F.col("side").alias("next_side"), *there)
        moved = going.drop("root").join(ahead, ["next_node", "next_side"]).select(
            "node", "side", F.col("there_next_node").alias("next_node"), F.col("there_next_side").alias("next_side"),
            (F.col("entered") + F.col("there_entered")).alias("entered"), (F.col("level") + F.col("there_level")).alias("level"), F.col("there_root").alias("root"),
        )
        state = cut(state.filter("root is not null").unionByName(moved))
    ends = state.groupBy("node").agg(F.first("root").alias("root"), *(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("entered", "level")))
    sizes = ends.filter("node = root").select("root", F.col("entered0").alias("size"))
    first = F.col("size") - F.col("entered0")
    labels = ends.join(sizes, "root").select(F.col("node").alias("id"), "root", first.alias("first"), (first + F.col("entered0") - F.col("entered1") - 1).alias("last"), (-F.col("level0")).alias("depth"))
    return cut(labels)


def labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of ids; one outside the forest is a tree of its own."""
    own = ids.select("id").filter("id is not null").distinct().join(labels, "id", "left")
    alone = {"root": F.coalesce("root", "id"), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("first", "last", "depth")}}
    return own.withColumns(alone)


def descendants(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) as traversal.descendants() gives: one range join of the seeds' intervals with all nodes' numbers."""
    spans = labelled(seeds, labels).select(F.col("id").alias("seed"), "root", F.col("first").alias("low"), F.col("last").alias("high"), F.col("depth").alias("seed_depth"))
    points = labels.select("id", "root", F.col("first").alias("at"), "depth").unionByName(alone(seeds, labels))
    pairs = dyadic_pairs(points, spans, "root", F.col("at"), F.col("low"), F.col("high")).filter("at between low and high")
    return pairs.select("seed", "id", (F.col("depth") - F.col("seed_depth")).cast("int").alias("depth"))


def reached_up(labels: DataFrame, seeds: DataFrame, kept: DataFrame) -> DataFrame:
    """(seed, id, depth) of what is kept (id) at or above the seeds: the same join the other way round, with the spans of what is kept alone."""
    points = labelled(seeds, labels).select(F.col("id").alias("seed"), "root", F.col("first").alias("at"), F.col("depth").alias("seed_depth"))
    spans = labels.select("id", "root", F.col("first").alias("low"), F.col("last").alias("high"), "depth").unionByName(alone(seeds, labels).select("id", "root", F.col("at").alias("low"), F.col("at").alias("high"), "depth"))
    spans = cut(spans.join(kept, "id", "left_semi"))
    pairs = dyadic_pairs(points, spans, "root", F.col("at"), F.col("low"), F.col("high"), stored=True).filter("at between low and high")
    return pairs.select("seed", "id", (F.col("seed_depth") - F.col("depth")).cast("int").alias("depth"))


def alone(seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """The seeds that no edge of the forest touches, each as a point of its own."""
    out = seeds.select("id").filter("id is not null").distinct().join(labels.select("id"), "id", "left_anti")
    return out.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("depth"))


def ancestors(nodes: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """traversal.ancestors() with labels."""
    kept = nodes.filter(F.col("node_type").isin("Repository", "Module", "File")).select("id")
    return reached_up(labels, seeds, kept)


def source_files_of(nodes: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """traversal.source_files_of() with labels."""
    files = nodes.filter(F.col("node_type") == "File").select("id")
    return reached_up(labels, seeds, files).groupBy("seed").agg(F.min(F.struct("depth", "id")).alias("nearest")).select("seed", F.col("nearest.id").alias("id"))
