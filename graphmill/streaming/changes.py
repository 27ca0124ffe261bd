"""File versions as a stream of changes: what each version did to its file, by state that outlives the query."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGED = T.StructType([T.StructField("path", T.StringType()), T.StructField("version", T.LongType()), T.StructField("status", T.StringType())])
STATE = T.StructType([T.StructField("version", T.LongType()), T.StructField("content_hash", T.StringType())])


def file_change_stream(versions: DataFrame) -> DataFrame:
    """(path, version, status): added, modified or deleted for each version that changes its file.

    versions: path, version (a number that grows with each version of a path) and content_hash (null: deleted), a stream in any
    order. Each path keeps its last version and hash in the state of the query. The versions of a micro-batch are taken in order; one
    that is not above the last is late, or a repetition, and is dropped; an equal hash is no change. A deleted path keeps its
    version, so that what comes late stays dropped. State is a few bytes a path, and a path is all that a task holds at once.
    """

    def step(key: tuple[Any, ...], batches: Iterator[Any], state: GroupState) -> Iterator[Any]:
        # Most paths have a row or two in a batch, where a table's own sort and joining cost far more than the rows.
        rows = sorted((row for batch in batches for row in zip(batch["version"].tolist(), batch["content_hash"].tolist())), key=itemgetter(0))
        last, held = state.get if state.exists else (None, None)
        out = []
        for version, content in rows:
            content = content if isinstance(content, str) else None
            if last is not None and version <= last:
                continue
            if held != content:
                out.append((version, "added" if held is None else "deleted" if content is None else "modified"))
            last, held = version, content
        if rows and last == rows[-1][0]:
            state.update((last, held))
        if out:
            import pandas as pd

            yield pd.DataFrame({"path": [key[0]] * len(out), "version": [v for v, _ in out], "status": [s for _, s in out]})

    known = versions.filter("path is not null and version is not null").select("path", "version", "content_hash")
    return known.groupBy("path").applyInPandasWithState(step, CHANGED, STATE, "append", GroupStateTimeout.NoTimeout)
