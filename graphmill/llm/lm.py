"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.storage import local_copy, new_folder, opened, worker_state

#: Stands for the end of a text, and as context for its start: no word holds white space.
END = b"\n"
#: A task's own counts go out once they reach so many entries.
FLUSH_ENTRIES = 2_000_000
#: A bucket is merged in slices of its key range, each of about so many bytes of counts before merging.
SLICE_BYTES = 32 << 20
#: The largest count that the arrays hold; larger ones are listed beside them.
MOST_COUNT = (1 << 32) - 1


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, each text's end among them, tokens per text)."""
    import xxhash

    from graphmill.llm.text import space_words

    parts, sizes = [], np.zeros(len(texts), np.int64)
    digest, end = xxhash.xxh3_64_intdigest, np.array([xxhash.xxh3_64_intdigest(END)], np.uint64)
    for k, text in enumerate(texts):
        words = space_words(text)
        parts += [np.fromiter(map(digest, words), np.uint64, len(words)), end]
        sizes[k] = len(words) + 1
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


class Tally:
    """A task's running counts; emits rows of sorted keys and counts, split by the keys' top bits into buckets and slices."""

    def __init__(self, bits: int, slice_bits: int = 0):
        self.bits, self.slice_bits, self.held, self.size = bits, slice_bits, [], 0

    def add(self, keys: np.ndarray) -> bool:
        keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > FLUSH_ENTRIES:
            self.merge()
        return self.size > FLUSH_ENTRIES // 2

    def merge(self):
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [(keys, counts)], len(keys)

    def rows(self):
        if not self.held:
            return
        self.merge()
        (keys, counts), self.held, self.size = self.held[0], [], 0
        cells = bucket_numbers(keys, self.bits + self.slice_bits)
        yield packed(keys, counts, cells, cells >> self.slice_bits)


def bucket_numbers(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, cells: np.ndarray, buckets: np.ndarray):
    """A batch of (bucket, cell, keys, counts), a row per cell: cells must ascend. Counts take as few bytes as they need."""
    import pyarrow as pa

    names, first = np.unique(cells, return_index=True)
    ends = [*first[1:], len(keys)]
    small = lambda c: c.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if c.max(initial=0) <= np.iinfo(k).max)).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets[first], pa.int64()), pa.array(names, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            pa.array([small(counts[a:b]) for a, b in zip(first, ends)], pa.binary()),
        ],
        ["bucket", "cell", "keys", "counts"],
    )


PACKED = "bucket long, cell long, keys binary, counts binary"
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(keys, np.uint64)
    return found, np.frombuffer(counts, WIDTHS[len(counts) // len(found)] if len(found) else np.uint8).astype(np.int64)


def merged(packs: DataFrame, schema: str, each) -> DataFrame:
    """Rows of `each(bucket, slices)`, once per bucket: slices are the bucket's cells in order, each an iterator of (keys,
    counts). A bucket is one task's, sorted by cell on its way, so that no more than a cell is in memory."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows = (r for batch in batches for r in zip(batch.column("bucket").to_pylist(), batch.column("cell").to_pylist(), batch.column("keys"), batch.column("counts")))
        for bucket, own in groupby(rows, lambda r: r[0]):
            cells = ((unpacked(r[2].as_py(), r[3].as_py()) for r in cell) for _, cell in groupby(own, lambda r: r[1]))
            yield pa.RecordBatch.from_pylist([{"bucket": bucket} | each(bucket, cells)], schema=kind)

    return packs.repartition("bucket").sortWithinPartitions("bucket", "cell").mapInArrow(run, schema)


class ArrayFile:
    """An array written piece by piece under a fresh name, so that a repeated task never touches another's file."""

    def __init__(self, folder: str, name: str):
        import uuid

        self.uri, self.size = f"{folder}/{name}-{uuid.uuid4().hex}", 0
        where, path = opened(self.uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = where.open_output_stream(path)

    def add(self, values: np.ndarray) -> None:
        self.sink.write(np.ascontiguousarray(values))
        self.size += len(values)

    def close(self) -> str:
        self.sink.close()
        return self.uri


@dataclass
class Model:
    """What a worker needs to score: the places of the arrays, by bucket, and the model's few global numbers."""

    bits: int
    words: dict[int, dict] = field(default_factory=dict)  # bucket: {keys, counts, n, base}
    stats: dict[int, str] = field(default_factory=dict)  # bucket: array (n, 4) of followers seen once, twice, more; predecessors
    pairs: dict[int, dict] = field(default_factory=dict)  # bucket: {keys, counts, n, large: {place: count}}
    train_tokens: int = 0
    vocabulary: int = 0
    pair_types: int = 0
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    word_rest: float = 1.0


def mapped(uri: str, dtype, columns: int = 1) -> np.ndarray:
    kept = worker_state().setdefault("maps", {})
    if uri not in kept:
        if len(kept) > 4096:
            kept.clear()
        a = np.memmap(local_copy(uri), dtype, mode="r")
        kept[uri] = a if columns == 1 else a.reshape(-1, columns)
    return kept[uri]


def found_in(files: dict[int, dict], bits: int, keys: np.ndarray):
    """For sorted keys: yields (where in keys, bucket, place in the bucket's array) of those that are there."""
    buckets = bucket_numbers(keys, bits)
    names, first = np.unique(buckets, return_index=True)
    for b, lo, hi in zip(names, first, [*first[1:], len(keys)]):
        if int(b) in files:
            there = mapped(files[int(b)]["keys"], np.uint64)
            place = np.searchsorted(there, keys[lo:hi])
            place[place == len(there)] = 0
            hit = np.flatnonzero(there[place] == keys[lo:hi])
            yield lo + hit, int(b), place[hit]


def word_ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id or -1, training count, predecessors and follower classes) of each hash, looked up once per distinct hash."""
    unique, back = np.unique(hashes, return_inverse=True)
    ids, counts, stats = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64), np.zeros((len(unique), 4), np.int64)
    for at, b, place in found_in(model.words, model.bits, unique):
        own = model.words[b]
        ids[at] = own["base"] + place
        counts[at] = mapped(own["counts"], np.int64)[place]
        if b in model.stats:
            stats[at] = mapped(model.stats[b], np.uint32, 4)[place]
    return ids[back], counts[back], stats[back]


def pair_keys(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(context ids, mixed keys of context and word): the first word of a text follows an end."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end_id
    return before, mixed((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))


def unmixed(keys: np.ndarray) -> np.ndarray:
    """The inverse of mixed()."""
    x = keys
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things seen once to four times; a half each where a number is missing."""
    if not all(n[:4]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(d, 0.01), k) for k, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2])))


def discounted(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def in_pieces(batches):
    from graphmill.llm.text import pieces

    for batch in batches:
        for begun, held in pieces(t.as_py() for t in batch.column("body")):
            yield batch, begun, held


def fit(docs: DataFrame, text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> Model:
    """Counts the model over all texts of docs and writes its arrays to the shared folder.

    Words, then pairs, are counted within each task and dealt by the top bits of a 64-bit hash, so hot words and pairs
    are pre-summed and every bucket gets an even share. A bucket is merged by one task slice by slice of its key range,
    as many slices as the size of the texts asks for, and written as it is merged, under a fresh name; the driver gets a
    few numbers per bucket. A word's id is its rank among the sorted hashes; words of one 64-bit hash count as one word.
    From the merged pairs follow each word's predecessors and its followers seen once, twice and more often.
    Null text counts as empty; a text without words is one end; repeated rows count each; an empty table gives a model
    that knows no word.
    """
    import math

    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    # A word takes about six bytes of text, and a key with its count nine or more.
    size = 2 * (texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    slice_bits = max(0, math.ceil(math.log2(max(1, size) / (slice_bytes << bits))))
    model = Model(bits)

    def count_words(batches):
        tally = Tally(bits, slice_bits)
        for _, _, held in in_pieces(batches):
            if tally.add(hashes_of(held)[0]):
                yield from tally.rows()
        yield from tally.rows()

    def write_words(bucket, cells):
        keys, counts, tokens = ArrayFile(folder, f"word-{bucket}"), ArrayFile(folder, f"count-{bucket}"), 0
        for cell in cells:
            k, c = summed(*map(np.concatenate, zip(*cell)))
            keys.add(k), counts.add(c)
            tokens += int(c.sum())
        return {"keys": keys.close(), "counts": counts.close(), "n": keys.size, "tokens": tokens}

    for r in sorted(merged(texts.mapInArrow(count_words, PACKED), "bucket long, keys string, counts string, n long, tokens long", write_words).collect()):
        model.words[r.bucket] = {"keys": r["keys"], "counts": r["counts"], "n": r.n, "base": model.vocabulary}
        model.vocabulary += r.n
        model.train_tokens += r.tokens
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2^32 distinct words do not fit the pair keys")

    def count_pairs(batches):
        tally = Tally(bits, slice_bits)
        for _, _, held in in_pieces(batches):
            hashes, sizes = hashes_of(held)
            ids, _, _ = word_ids(model, hashes)
            if tally.add(pair_keys(ids, sizes, int(ids[sizes[0] - 1]))[1]):
                yield from tally.rows()
        yield from tally.rows()

    def write_pairs(bucket, cells):
        keys, counts, seen, large = ArrayFile(folder, f"pair-{bucket}"), ArrayFile(folder, f"pairs-{bucket}"), np.zeros(4, np.int64), []
        for cell in cells:
            k, c = summed(*map(np.concatenate, zip(*cell)))
            large += [{"place": keys.size + int(i), "n": int(c[i])} for i in np.flatnonzero(c > MOST_COUNT)]
            seen += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
            keys.add(k), counts.add(np.minimum(c, MOST_COUNT).astype(np.uint32))
        return {"keys": keys.close(), "counts": counts.close(), "n": keys.size, "seen": seen.tolist(), "large": large}

    seen = np.zeros(4, np.int64)
    for r in merged(texts.mapInArrow(count_pairs, PACKED), "bucket long, keys string, counts string, n long, seen array<long>, large array<struct<place:long,n:long>>", write_pairs).collect():
        model.pairs[r.bucket] = {"keys": r["keys"], "counts": r["counts"], "n": r.n, "large": {x.place: x.n for x in r.large}}
        model.pair_types += r.n
        seen += r.seen
    model.pair_discounts = discounts(seen.tolist())

    bases = np.array([w["base"] for w in model.words.values()] or [0])
    names = np.array(list(model.words) or [0])

    def count_stats(batches):
        """Partial sums of a word's four numbers, keyed by its id and which of them: 4 * id + kind."""
        for batch in batches:
            for b in batch.column("bucket").to_pylist():
                for at in range(0, model.pairs[b]["n"], FLUSH_ENTRIES):
                    keys, counts = (np.asarray(mapped(model.pairs[b][c], kind)[at : at + FLUSH_ENTRIES]) for c, kind in (("keys", np.uint64), ("counts", np.uint32)))
                    pair = unmixed(keys)
                    kinds = np.minimum(counts, 3).astype(np.uint64) - np.uint64(1)
                    both = np.concatenate([(pair >> np.uint64(32)) * np.uint64(4) + kinds, (pair & np.uint64(0xFFFFFFFF)) * np.uint64(4) + np.uint64(3)])
                    keys, sums = np.unique(both, return_counts=True)
                    owner = names[np.searchsorted(bases, (keys // np.uint64(4)).astype(np.int64), side="right") - 1]
                    yield packed(keys, sums.astype(np.int64), owner, owner)

    def write_stats(bucket, cells):
        own = model.words[bucket]
        # As many rows as the bucket has words; a word has at most as many neighbours as there are words.
        stats = np.zeros((own["n"], 4), np.uint32)
        for cell in cells:
            for keys, sums in cell:
                stats.reshape(-1)[keys.astype(np.int64) - 4 * own["base"]] += sums.astype(np.uint32)
        seen = [int((stats[:, 3] == k).sum()) for k in (1, 2, 3, 4)] + [int((stats[:, 3] >= 3).sum())]
        file = ArrayFile(folder, f"stats-{bucket}")
        file.add(stats)
        return {"path": file.close(), "seen": seen}

    jobs = spark.createDataFrame([(b,) for b in model.pairs], "bucket long").repartition(max(1, len(model.pairs)), "bucket") if model.pairs else None
    seen = np.zeros(5, np.int64)
    if jobs is not None:
        for r in merged(jobs.mapInArrow(count_stats, PACKED), "bucket long, path string, seen array<long>", write_stats).collect():
            model.stats[r.bucket] = r.path
            seen += r.seen
    model.word_discounts = discounts(seen[:4].tolist())
    d = model.word_discounts
    model.word_rest = float((d[0] * seen[0] + d[1] * seen[1] + d[2] * seen[4]) / model.pair_types) if model.pair_types else 1.0
    return model


def log_probabilities(model: Model, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of the bigram model, log10 of the add-one unigram base, training count) of every token."""
    ids, counts, stats = word_ids(model, hashes)
    space = model.vocabulary + 1
    base = np.log10((counts + 1) / (model.train_tokens + space))
    word = discounted(stats[:, 3], model.word_discounts) / max(1, model.pair_types) + model.word_rest / space
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    before_count, before_stats, before = np.empty_like(counts), np.empty_like(stats), np.empty_like(ids)
    before[1:], before_count[1:], before_stats[1:] = ids[:-1], counts[:-1], stats[:-1]
    before[first], before_count[first], before_stats[first] = ids[last[0]], counts[last[0]], stats[last[0]]
    _, keys = pair_keys(np.where(ids < 0, 0, ids), sizes, max(0, int(ids[last[0]])))
    keys = np.where((ids < 0) | (before < 0), np.uint64(0), keys)
    unique, back = np.unique(keys, return_inverse=True)
    seen = np.zeros(len(unique), np.int64)
    for at, b, place in found_in(model.pairs, model.bits, unique):
        seen[at] = mapped(model.pairs[b]["counts"], np.uint32)[place]
        if large := model.pairs[b]["large"]:
            seen[at] = [large.get(p, n) for p, n in zip(place.tolist(), seen[at].tolist())]
    seen = np.where((ids < 0) | (before < 0), 0, seen[back])
    total = np.maximum(before_count, 1)
    rest = np.where(before_count > 0, before_stats[:, :3] @ np.array(model.pair_discounts) / total, 1.0)
    return np.log10(discounted(seen, model.pair_discounts) / total + rest * word), base, counts


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of docs with n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text.

    Each row is scored apart, so repeated rows get equal results and an empty table gives no rows. Null text counts as
    empty, which is one end. An unknown word has the probability that the model leaves to all of them.
    """
    import pyarrow as pa

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def scored(batches):
        for batch, begun, held in in_pieces(batches):
            hashes, sizes = hashes_of(held)
            own, base, counts = log_probabilities(model, hashes, sizes)
            first = np.cumsum(sizes) - sizes
            total, base = np.add.reduceat(own, first), np.add.reduceat(base, first)
            known = np.add.reduceat((counts > 0).astype(np.int64), first)
            values = [sizes, known, np.full(len(held), model.train_tokens, np.int64), base, total, 10.0 ** np.minimum(-total / sizes, 300)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}").slice(begun, len(held)) for i in range(len(keep))), *map(pa.array, values)], [*(f"k{i}" for i in range(len(keep))), *added])

    schema = T.StructType(
        [*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), *(T.StructField(c, T.LongType()) for c in added[:3]), *(T.StructField(c, T.DoubleType()) for c in added[3:])]
    )
    return rows.mapInArrow(scored, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *added)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 7; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7))
