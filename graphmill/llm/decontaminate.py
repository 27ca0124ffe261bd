"""Benchmark decontamination with a document-sharded positional inverted index."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.storage import stored

WINDOW = 10
#: Test items are taken in blocks of at most so many bytes of text; a block's terms and windows go to the workers.
BLOCK_BYTES = 4 << 20


class PhraseBlock:
    """The windows of a block of test items [(item id as string, text bytes)], as arrays: `ids` are the term ids of all items
    end to end; per window length, `starts` are the places in `ids` of its different windows and `items[begin[w]:begin[w + 1]]`
    the items that window w is of. A block is sent to every task: it takes about three times its text."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        from graphmill.llm.text import alnum_words

        self.names: list[str] = []
        self.vocab: dict[bytes, int] = {}
        sizes, parts = [], []
        for name, text in items:
            words = alnum_words(text or b"")
            if words:
                self.names.append(name)
                sizes.append(len(words))
                parts.append(np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words), np.int32, len(words)))
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        #: {length: (starts, begin, items)}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(sizes, window)
        for k in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == k)
            counts = sizes[own] - k + 1
            item = np.repeat(own, counts)
            at = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends[own] - sizes[own], counts)
            _, first, which = np.unique(np.lib.stride_tricks.sliding_window_view(self.ids, k)[at], axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
            self.windows[k] = (at[first], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1])

    def terms(self, k: int) -> np.ndarray:
        """The windows of length k, a row of term ids each."""
        return np.lib.stride_tricks.sliding_window_view(self.ids, k)[self.windows[k][0]].astype(np.int64)


def index_shard(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(words per text, different words, postings per word, posting positions by word and then position). Positions count
    all words of the shard, with a gap of one after each text, so no phrase crosses a text's end."""
    from collections import defaultdict

    from graphmill.llm.text import alnum_words

    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    look = vocab.__getitem__
    n_words = np.zeros(len(texts), np.int64)
    terms, places, at = [], [], 0
    for k, text in enumerate(texts):
        words = alnum_words(text)
        n_words[k] = len(words)
        terms.append(np.fromiter(map(look, words), np.int32, len(words)))
        places.append(np.arange(at, at + len(words)))
        at += len(words) + 1
    terms = np.concatenate(terms) if terms else np.empty(0, np.int32)
    order = np.argsort(terms, kind="stable")
    return n_words, list(vocab), np.bincount(terms, minlength=len(vocab)), (np.concatenate(places) if places else np.empty(0, np.int64))[order]


class Shard:
    """Posting lists of one index shard for a block's terms: sorted keys of term and position."""

    def __init__(self, words: list[bytes], counts: np.ndarray, places: np.ndarray, vocab: dict[bytes, int]):
        term = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(term >= 0)
        known = known[np.argsort(term[known])]
        size, first = counts[known], (np.cumsum(counts) - counts)[known]
        ends = np.cumsum(size)
        self.places = places[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        self.keys = (np.repeat(term[known], size) << 40) | self.places
        sizes = np.zeros(len(vocab), np.int64)
        sizes[term[known]] = size
        self.begin = np.concatenate([[0], np.cumsum(sizes)])

    def has(self, terms, places) -> np.ndarray:
        keys = (terms << 40) | places
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return (places >= 0) & (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def phrases(self, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window row, first position) of every occurrence: the list of a window's rarest term, moved back by its
        offset, is intersected with the lists of the next rarest, each moved by its own. order: the places of each
        window's terms, rarest first."""
        rows = np.arange(len(windows))
        lead = windows[rows, order[:, 0]]
        counts = self.begin[lead + 1] - self.begin[lead]
        row = np.repeat(rows, counts)
        first = np.cumsum(counts) - counts
        start = self.places[np.arange(len(row)) - np.repeat(first - self.begin[lead], counts)] - order[row, 0]
        for j in range(1, windows.shape[1]):
            if not len(row):
                break
            offset = order[row, j]
            keep = self.has(windows[row, offset], start + offset)
            row, start = row[keep], start[keep]
        keep = start >= 0
        return row[keep], start[keep]

    def near(self, terms: list[int], frequency: np.ndarray, slop: int) -> list[int]:
        """First positions of the spans of at most `slop` words that hold all `terms`, in any order, started at each
        occurrence of any of them."""
        lists = [self.places[self.begin[t] : self.begin[t + 1]] for t in sorted(set(terms), key=lambda t: frequency[t])]
        if any(not len(x) for x in lists):
            return []
        starts = np.unique(np.concatenate(lists))
        for x in lists:
            at = np.searchsorted(x, starts)
            reach = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], np.iinfo(np.int64).max)
            starts = starts[reach < starts + slop]
        return starts.tolist()


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stored index of the training texts, for any test items: a row per shard (a run of documents) with its ids, word
    counts, different words and their posting lists. Shards hold whole texts and about 4 MB, or one longer text; nothing
    is shuffled."""
    import pyarrow as pa

    from graphmill.llm.text import pieces

    id_type = docs.schema[id_col].dataType
    binary = [T.StructField(c, T.BinaryType()) for c in ("words", "counts", "places")]
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.LongType())), *binary])

    def shards(batches):
        for batch in batches:
            ids = batch.column("id")
            texts = (t.as_py() for t in batch.column("body"))
            for begun, held in pieces(texts):
                n_words, words, counts, places = index_shard(held)
                steps = np.diff(places, prepend=0)
                own = ids.slice(begun, len(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                        pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(n_words)),
                        pa.array([b" ".join(words)], pa.binary()),
                        pa.array([narrow(counts)], pa.binary()),
                        pa.array([narrow(steps)], pa.binary()),
                    ],
                    ["ids", "n_words", "words", "counts", "places"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    return stored(source.mapInArrow(shards, schema), "postings")


def narrow(values: np.ndarray) -> bytes:
    """Four bytes a value, or eight where one needs them."""
    wide = len(values) and (values.max() >= 1 << 31 or values.min() < -(1 << 31))
    return values.astype(np.int64 if wide else np.int32).tobytes()


def widened(values: bytes, n: int) -> np.ndarray:
    return np.frombuffer(values, np.int64 if n and len(values) == 8 * n else np.int32).astype(np.int64)


def shard_of(batch, row: int, vocab: dict[bytes, int]) -> Shard:
    words = batch.column("words")[row].as_py().split()
    counts = widened(batch.column("counts")[row].as_py(), len(words))
    return Shard(words, counts, np.cumsum(widened(batch.column("places")[row].as_py(), int(counts.sum()))), vocab)


def term_frequencies(index: DataFrame, vocab: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each test term over the whole corpus. The result is as long as the block's vocabulary."""
    import pyarrow as pa

    def counted(batches):
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts")):
                words = words.as_py().split()
                term = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
                total[term[term >= 0]] += widened(counts.as_py(), len(words))[term >= 0]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    out = np.zeros(len(vocab), np.int64)
    for r in index.select("words", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def phrase_hits(index: DataFrame, block: PhraseBlock, frequency: np.ndarray) -> DataFrame:
    """One row per document: id, n_words, `hits` (word positions inside an occurrence) and `items`."""
    import pyarrow as pa

    def matched(batches):
        ranked = {k: (terms := block.terms(k), np.argsort(frequency[terms], axis=1, kind="stable")) for k in block.windows}
        for batch in batches:
            for shard_row in range(batch.num_rows):
                n_words = batch.column("n_words")[shard_row].values.to_numpy()
                ids = batch.column("ids")[shard_row].values
                shard = shard_of(batch, shard_row, block.vocab)
                ends = np.cumsum(n_words + 1)
                begins = ends - n_words - 1
                covered = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
                found: dict[int, set[int]] = {}
                for length, (_, begin, items) in block.windows.items():
                    row, start = shard.phrases(*ranked[length])
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + length, -1)
                    doc = np.searchsorted(ends, start, side="right")
                    for d, r in np.unique(np.stack([doc, row], 1), axis=0) if len(row) else ():
                        found.setdefault(int(d), set()).update(items[begin[r] : begin[r + 1]].tolist())
                inside = np.flatnonzero(np.cumsum(covered) > 0)
                doc = np.searchsorted(ends, inside, side="right")
                cut = np.searchsorted(doc, np.arange(len(n_words) + 1))
                hits = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(inside - begins[doc]))
                names = [sorted({block.names[i] for i in found.get(k, ())}) for k in range(len(n_words))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), hits, pa.array(names, pa.list_(pa.string()))], ["id", "n_words", "hits", "items"])

    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    return index.mapInArrow(matched, schema)


def blocks_of(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES):
    """PhraseBlocks over all test items, streamed to the driver one block at a time."""
    held, size = [], 0
    for r in items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).toLocalIterator():
        text = r.text.encode()
        if held and size + len(text) > block_bytes:
            yield PhraseBlock(held, window)
            held, size = [], 0
        held.append((r.item or "", text))
        size += len(text)
    yield PhraseBlock(held, window)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document with the words that lie inside an exact occurrence of a window of a test item.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A window is `window` consecutive words
    of an item; a shorter item is one window. The corpus is indexed once: shards of whole documents hold the sorted
    posting lists of all their words. The test items are a stated query set, taken in blocks of a fixed size, each
    matched against the stored index: term frequencies over the corpus rank the terms of each window; the rarest term's
    postings, moved by its offset, are intersected with the others in order of rarity. Matching is local to a shard, so
    neither hot terms nor hot passages gather anywhere. Null or empty texts have no words; items without words match
    nothing; repeated rows are judged apart; other columns are not read; an empty table gives no rows.

    Columns: id_col, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    blocks = blocks_of(items, item_col, item_text_col, window, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        index = build_index(docs, id_col, text_col)
        hits = phrase_hits(index, first, term_frequencies(index, first.vocab))
        judged = hits.select(F.col("id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), "items")
    else:
        # Rows get numbers, so that a row's hits from all blocks meet again.
        numbered = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), F.col(text_col).alias("body"))
        index = build_index(numbered, "key", "body")
        found = None
        for block in chain((first, second), blocks):
            # A block's hits are stored without the documents that have none, so no later plan holds the block.
            hits = phrase_hits(index, block, term_frequencies(index, block.vocab)).filter(F.size("items") > 0)
            hits = stored(hits.select(F.col("id.row").alias("row"), "hits", "items"), "block-hits")
            found = hits if found is None else found.unionByName(hits)
        merged = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        rows = index.select(F.explode(F.arrays_zip("ids", "n_words")).alias("x")).select(F.col("x.ids.id").alias(id_col), F.col("x.ids.row").alias("row"), F.col("x.n_words").alias("n_words"))
        judged = rows.join(merged, "row", "left").select(id_col, "n_words", F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    listed = F.array_join(F.array_sort("items"), ",")
    out = judged.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
    # Whoever has stored the result may discard the index.
    out.graphmill_index = index
    return out


def proximity_matches(docs: DataFrame, phrases: list[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, phrase, position): spans of at most `slop` words that hold all words of a phrase in any order.

    position is the span's first word, which is one of the phrase's. Phrases without words match nothing. Uses the
    same index and, like the exact matches, looks at each document apart.
    """
    import pyarrow as pa

    from graphmill.llm.text import alnum_words

    block = PhraseBlock([(p, p.encode()) for p in phrases], WINDOW)
    index = build_index(docs, id_col, text_col)
    frequency = term_frequencies(index, block.vocab)
    wanted = [(p, [block.vocab[w] for w in alnum_words(p.encode())]) for p in phrases]

    def matched(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n_words = batch.column("n_words")[k].values.to_numpy()
                ids, ends = batch.column("ids")[k].values, np.cumsum(n_words + 1)
                shard = shard_of(batch, k, block.vocab)
                # Texts lie `slop` words apart here, so that no span joins two of them.
                shard.places = shard.places + np.searchsorted(ends, shard.places, side="right") * slop
                for phrase, own in wanted:
                    starts = np.array(shard.near(own, frequency, slop) if own else [], np.int64)
                    if len(starts):
                        spread = ends - n_words - 1 + np.arange(len(ends)) * slop
                        at = np.searchsorted(spread, starts, side="right") - 1
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([phrase] * len(at)), pa.array(starts - spread[at])], ["id", "phrase", "position"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("phrase", T.StringType()), T.StructField("position", T.LongType())])
    return index.mapInArrow(matched, schema).withColumnRenamed("id", id_col)
