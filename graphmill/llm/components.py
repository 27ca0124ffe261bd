"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.storage import discard, stored


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the least of its component; root is that least node.

    Alternates the large-star and small-star steps. Each is one grouped minimum, which combines before the shuffle,
    and one join back to the edges, which adaptive execution may split; no neighbour list is ever gathered. The
    number of rounds is logarithmic in practice. Nodes must be orderable and non-null; loops are dropped. The result is a
    stored table, which discard() removes.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "stars"
    )
    mark, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct(), "stars", n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.filter("u != v").distinct(), "stars", n)
        new_mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(now)
        now = after
        if new_mark == mark:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.graphmill_folder = now.graphmill_folder
            return found
        mark, n = new_mark, new_mark[0]
