"""A stream of file versions merged into a stored graph, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphmill.sources.store import GraphStore


def merge_stream(nodes: DataFrame, store: GraphStore, edges_of, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch of nodes, with the edges that edges_of(batch) gives. An upsert repeated after a failure
    changes nothing, so every batch counts once. Runs until the source has no more, then ends."""

    def upsert(batch: DataFrame, _: int) -> None:
        store.upsert(batch, edges_of(batch))

    return nodes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
