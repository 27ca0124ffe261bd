"""Token-id output: Arrow stream files of fixed-size-list batches, and readers with random access by arithmetic."""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.storage import local_copy, new_folder, opened, stored, worker_state
from graphmill.sources.shared import qualified

SEQUENCE = 1024
ROWS_PER_BATCH = 64
#: Entries that a worker's memo of encoded pieces may hold; pieces beyond are encoded anew each time.
MEMO_ENTRIES = 800_000

TWO_SPACES = re.compile(r"\s\s")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
LINE = re.compile(r" ?\S(?:[^\n]*\S)?")


class PieceEncoder:
    """Encodes whole texts with the tokenizers library, as it loads the file, and remembers the ids of their pieces.

    A byte-level BPE of this kind splits text before a space that stands between two other characters, and before a
    line feed there, so such pieces can be encoded apart. Texts that hold the string of an added token, which becomes that
    token's id, are encoded whole; so are all texts for any other tokenizer.
    """

    def __init__(self, path: str, most: int = MEMO_ENTRIES):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.most = most
        #: Ids of all known pieces, end to end; piece k has flat[begin[k]:begin[k + 1]].
        self.flat, self.begin, self.known = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0
        self.memo: dict[str, int] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def split(self, text: str) -> list[str]:
        """Pieces as memo keys: the literal piece, but without its space where a space leads it and no line feed does."""
        if TWO_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
            parts = BEFORE_SPACE.split(text)
            return ["\0" + parts[0], *(p[1:] if p[1] != "\n" and p[1] != "\0" else "\0" + p for p in parts[1:])]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        if "\0" in text:
            return [parts[0], *("\0 " + p if p[0] == "\0" else p for p in parts[1:])]
        return parts

    @staticmethod
    def literal(key: str) -> str:
        return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key

    def apart(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, ids per piece). Pieces without a line feed that neither start nor end with white space, but for one
        space before another character, are encoded as lines of one text: a line feed between two of them is an id of its own. Should
        there be another number of line feeds than of ends of lines, they are encoded apart as well."""
        texts = [self.literal(k) for k in keys]
        lines = [k for k, t in enumerate(texts) if self.line is not None and t and LINE.fullmatch(t)]
        found: dict[int, np.ndarray] = {}
        if lines:
            ids = self.apart(["\n".join(texts[k] for k in lines)])[0]
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(lines) - 1:
                sizes = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                if len(lines) == len(texts):
                    return ids[ids != self.line], sizes
                found = dict(zip(lines, np.split(ids[ids != self.line], np.cumsum(sizes)[:-1])))
        rest = [k for k in range(len(texts)) if k not in found]
        found |= zip(rest, self.apart([texts[k] for k in rest]))
        parts = [found[k] for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def learn(self, keys: list[str]) -> None:
        """Appends the ids of new pieces; as many as the memo has room for stay there."""
        for at in range(0, len(keys), 4096):
            ids, sizes = self.fresh(keys[at : at + 4096])
            end = self.begin[self.known]
            while end + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while self.known + len(sizes) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.flat[end : end + len(ids)] = ids
            self.begin[self.known + 1 : self.known + 1 + len(sizes)] = end + np.cumsum(sizes)
            self.known += len(sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        odd = [k for k, t in enumerate(texts) if self.added is not None and self.added.search(t)]
        if odd:
            whole = dict(zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in whole]))
            return [np.array(whole[k].ids, np.uint32) if k in whole else next(rest) for k in range(len(texts))]
        split = [self.split(t) if t else [] for t in texts]
        keys = list(chain.from_iterable(split))
        rows = np.fromiter(map(self.memo.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(rows < 0)
        kept = self.known
        if len(missing):
            new: dict[str, int] = {}
            rows[missing] = [new.setdefault(keys[i], kept + len(new)) for i in missing]
            self.learn(list(new))
            room = self.most - len(self.memo)
            self.memo.update(new if len(new) <= room else islice(new.items(), max(0, room)))
            kept += min(len(new), max(0, room))
        sizes = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[rows] - (ends - sizes), sizes)]
        # What the memo has no room for is forgotten again.
        self.known = kept
        last = np.cumsum([len(x) for x in split])
        return np.split(ids, np.concatenate([[0], ends])[last][:-1]) if texts else []


class SequenceWriter:
    """An Arrow stream file of {ids: fixed list of L, mask: fixed list of L}: ids run on across sequences, the mask is
    true for real ids and false for the padding of the last sequence. All batches have as many rows, so the file is a
    header and messages of one size: any sequence, and so any id, lies at a place found by arithmetic."""

    def __init__(self, sink, dtype, length: int = SEQUENCE, rows: int = ROWS_PER_BATCH):
        import pyarrow as pa

        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.schema = sequence_schema(self.dtype, length)
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        whole = self.length * self.rows
        if self.size >= whole:
            run = np.concatenate(self.held)
            at = 0
            while len(run) - at >= whole:
                self._write(run[at : at + whole], whole)
                at += whole
            self.held, self.size = [run[at:]], len(run) - at

    def _write(self, run: np.ndarray, real: int) -> None:
        import pyarrow as pa

        mask = np.arange(len(run)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (run, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.written += real

    def close(self) -> int:
        if self.size:
            run = np.concatenate(self.held)
            whole = self.length * self.rows
            self._write(np.concatenate([run, np.zeros(whole - len(run), self.dtype)]), len(run))
        self.writer.close()
        return self.written


def sequence_schema(dtype, length: int):
    import pyarrow as pa

    one = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
    return pa.schema([pa.field("ids", one(pa.from_numpy_dtype(dtype)), nullable=False), pa.field("mask", one(pa.bool_()), nullable=False)])


class SequenceReader:
    """Random access to a file of SequenceWriter through a memory map; slices within a batch are views of it."""

    def __init__(self, path: str):
        import pyarrow as pa

        self.source = pa.memory_map(path)
        stream = pa.ipc.open_stream(self.source)
        self.schema = stream.schema
        self.header = self.source.tell()
        self.kind = self.schema.field("ids").type
        self.length = self.kind.list_size
        try:
            first = pa.ipc.read_message(self.source)
            self.rows = pa.ipc.read_record_batch(first, self.schema).num_rows
            self.message = self.source.tell() - self.header
        except (EOFError, pa.ArrowInvalid):
            self.rows, self.message = 0, 0
        self.last = (-1, None)

    def batch(self, k: int):
        import pyarrow as pa

        if self.last[0] != k:
            self.source.seek(self.header + k * self.message)
            self.last = (k, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema))
        return self.last[1]

    def sequence(self, n: int):
        """(ids, mask) of the n-th sequence."""
        batch, row = self.batch(n // self.rows), n % self.rows
        return batch.column("ids").values[row * self.length : (row + 1) * self.length].to_numpy(), batch.column("mask").values[row * self.length : (row + 1) * self.length]

    def ids(self, start: int, count: int) -> np.ndarray:
        parts, whole = [], self.rows * self.length
        while count > 0:
            k, at = divmod(start, whole)
            take = min(count, whole - at)
            parts.append(self.batch(k).column("ids").values.slice(at, take).to_numpy())
            start, count = start + take, count - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, self.kind.value_type.to_pandas_dtype())


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, length: int = SEQUENCE
) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the ids as Arrow stream files in ascending id order.

    Rows are dealt to range partitions of id_col and sorted there; each task writes one shard file, named afresh so
    that a repeated task never touches another's, and the stored index names the files that count. Null text counts
    as empty (the end id alone); null ids come first; rows of one id keep their order by text; an empty input has
    no file. Ids take two bytes where the vocabulary allows it.

    Columns of the index: id_col, path, place (the row's first id within its shard), n_tokens, shard, start (ids of
    all rows before it).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(wanted, "id").sortWithinPartitions("id", "body")

    def encoder():
        kept = worker_state()
        if kept.get("tokenizer") != tokenizer_path:
            kept["tokenizer"], kept["encoder"] = tokenizer_path, PieceEncoder(tokenizer_path)
        return kept["encoder"]

    def write(batches):
        import uuid

        from pyspark import TaskContext

        from graphmill.llm.text import pieces

        shard, path, writer, sink = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                code = encoder()
                dtype = np.uint16 if max(code.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
                path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.arrows"
                where, name = opened(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                sink = where.open_output_stream(name)
                writer = SequenceWriter(sink, dtype, length)
                at = 0
            for begun, held in pieces((t.as_py() for t in batch.column("body").cast(pa.binary())), 1 << 20):
                sizes = []
                for ids in code.encode([t.decode() for t in held]):
                    writer.add(np.append(ids, np.uint32(end_id)))
                    sizes.append(len(ids) + 1)
                places = at + np.cumsum(sizes) - sizes
                at += sum(sizes)
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begun, n), pa.array([path] * n), pa.array(places), pa.array(np.array(sizes, np.int64)), pa.array(np.full(n, shard, np.int64))],
                    ["id", "path", "place", "n_tokens", "shard"],
                )
        if writer is not None:
            writer.close()
            sink.close()

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("shard", T.LongType())]
    )
    index = stored(dealt.mapInArrow(write, schema), "token-index")
    # One row per shard file: a few values for each write task, whatever the number of documents.
    sizes = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, before = [], 0
    for shard, n in sizes:
        bases.append((shard, before))
        before += n
    base = spark.createDataFrame(bases, "shard long, base long")
    return index.join(F.broadcast(base), "shard").select(F.col("id").alias(id_col), "path", "place", "n_tokens", "shard", (F.col("base") + F.col("place")).alias("start"))


def read_documents(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32): every document's ids read back from the files by random access."""
    import pyarrow as pa

    def read(batches):
        reader, at = None, None
        for batch in batches:
            sums = []
            for path, place, n in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "n_tokens"))):
                if path != at:
                    reader, at = SequenceReader(local_copy(path)), path
                sums.append(zlib.crc32(np.ascontiguousarray(reader.ids(place, n), dtype="<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([index.schema[id_col], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return index.select(id_col, "path", "place", "start", "n_tokens").mapInArrow(read, schema)
