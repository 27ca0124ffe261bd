"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, then distributed components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.components import connected
from graphmill.llm.storage import discard, stored

LEAF_ROWS = 2048
PIVOT_SAMPLE = 65536
BRUTE = 512
#: A leaf of more fingerprints is split again on the executors, by a tree over about LEAF_SAMPLE of them; one that no
#: vantage point cuts is compared block with block, each pair of blocks as large as such a leaf. A leaf of this size takes
#: a task a second or two, while each further level copies about a fifth of the points over its cut.
LEAF_MOST = 16 * LEAF_ROWS
LEAF_SAMPLE = 4096
#: A cut that leaves more than this share of a leaf on one side is none.
STUCK = 0.9
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint_of(text: bytes, shingle: int) -> int:
    """Bit i is set where over half of the shingles' XXH64 hashes (seed 42) have it; no words give zero."""
    import xxhash

    from graphmill.llm.text import space_words

    words = space_words(text)
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    lanes = hashes.view(np.uint8).reshape(-1, 8)  # little-endian: lane j holds bits 8j to 8j+7
    half, value = len(hashes) / 2, 0
    for j in range(8):
        counts = np.bincount(lanes[:, j], minlength=256)
        for bit in np.flatnonzero(counts @ BYTE_BITS > half):
            value |= 1 << (8 * j + int(bit))
    return value


BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def with_fingerprints(rows: DataFrame, text_col: str, shingle: int = 3) -> DataFrame:
    """rows with text_col replaced by `fp`, the signed 64-bit fingerprint of the whole text; null text counts as empty. A
    column of that name is replaced."""
    import pyarrow as pa
    from pyspark.sql import types as T

    others = [c for c in rows.columns if c not in (text_col, "fp")]

    def prints(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            found = np.array([fingerprint_of(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found)], [*others, "fp"])

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(prints, schema)


def distances(values: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(values ^ pivot).astype(np.int64)


def best_cut(dist: np.ndarray, radius: int) -> int:
    """The cut between the 30 % and 70 % quantiles whose inner boundary holds the fewest points."""
    counts = np.bincount(dist, minlength=66)
    share = np.cumsum(counts) / max(1, len(dist))
    span = [m for m in range(65) if 0.3 <= share[m] <= 0.7] or [int(np.searchsorted(share, 0.5))]
    return min(span, key=lambda m: (counts[max(0, m - radius + 1) : m + 1].sum(), m))


def build_tree(sample: np.ndarray, depth: int, radius: int, seed: int = 7) -> list:
    """Nested [vantage point, cut, near side, far side]; an empty list is a leaf."""
    if depth == 0 or len(sample) < 4:
        return []
    pivot = sample[(seed * 2654435761) % len(sample)]
    dist = distances(sample, pivot)
    cut = best_cut(dist, radius)
    near, far = sample[dist <= cut], sample[dist > cut]
    if not len(near) or not len(far):
        return []
    return [int(pivot), cut, build_tree(near, depth - 1, radius, 2 * seed), build_tree(far, depth - 1, radius, 2 * seed + 1)]


def route(values: np.ndarray, tree: list, radius: int, leaf: int = 1):
    """(leaf, values) pairs. By the triangle bound a near point can only link across the cut from its outermost
    `radius` shells, so those go to both sides and every linked pair meets in a leaf."""
    if not len(values):
        return
    if not tree:
        yield leaf, values
        return
    pivot, cut, near, far = tree
    dist = distances(values, np.uint64(pivot))
    yield from route(values[dist <= cut], near, radius, 2 * leaf)
    yield from route(values[dist > cut - radius], far, radius, 2 * leaf + 1)


def leaf_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one leaf, found exactly: the tree goes on in memory down to small
    blocks, which are compared outright."""
    values = np.unique(values)
    label = np.arange(len(values))
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle():
        nonlocal held
        if not pending:
            return
        a, b = (np.concatenate(x) for x in zip(*pending))
        pending.clear()
        held = 0
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
            if np.array_equal(before, label):
                return

    def compare(rows: np.ndarray, cols: np.ndarray):
        nonlocal held
        for at in range(0, len(rows), BRUTE):
            block = rows[at : at + BRUTE]
            for other in range(0, len(cols), 4096):
                part = cols[other : other + 4096]
                x, y = np.nonzero(np.bitwise_count(values[block][:, None] ^ values[part][None, :]) <= radius)
                keep = block[x] < part[y]
                if keep.any():
                    pending.append((block[x[keep]], part[y[keep]]))
                    held += int(keep.sum())
            if held > 1 << 20:
                settle()

    stack = [np.arange(len(values))]
    turn = 1
    while stack:
        rows = stack.pop()
        if len(rows) <= BRUTE:
            compare(rows, rows)
            continue
        turn += 1
        dist = distances(values[rows], values[rows[(turn * 2654435761) % len(rows)]])
        cut = best_cut(dist, radius)
        near, far = rows[dist <= cut], rows[dist > cut - radius]
        if max(len(near), len(far)) > 0.9 * len(rows):
            compare(rows, rows)
        else:
            stack += [near, far]
    settle()
    child = np.flatnonzero(label != np.arange(len(values)))
    return values[child], values[label[child]]


def cells_of(points: DataFrame, tree: list, radius: int, leaf_most: int = LEAF_MOST) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, low, high, fp), and the stored tables it reads: the points (fp) dealt to cells such that every pair within `radius` meets in one, and no cell
    has many more than leaf_most points.

    The given tree deals first. Leaves that are too large get trees of their own, built on the executors from samples of
    their points, until none is left or their largest part stays as large: those are cut into blocks, every two of which
    are a cell.
    """
    import json

    import pyarrow as pa

    def dealt(batches, trees):
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for own, parent, size, root in trees(batch):
                for leaf, part in route(values[own], root, radius):
                    name = (leaf * int(MIX) ^ parent * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF if parent else leaf
                    out.append((np.full(len(part), name, np.uint64), np.full(len(part), size, np.int64), part))
            leaves, sizes, points = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), values[:0])
            yield pa.RecordBatch.from_arrays([pa.array(leaves.view(np.int64)), pa.array(sizes), pa.array(points.view(np.int64))], ["leaf", "above", "fp"])

    def first(batches):
        yield from dealt(batches, lambda batch: [(slice(None), 0, 0, tree)])

    def again(batches):
        def trees(batch):
            names, at, back = np.unique(batch.column("leaf").to_numpy(), return_index=True, return_inverse=True)
            for k, (name, i) in enumerate(zip(names.tolist(), at)):
                yield back == k, name, batch.column("n")[i].as_py(), json.loads(batch.column("tree")[i].as_py())

        yield from dealt(batches, trees)

    def plant(table):
        n = table.column("n")[0].as_py()
        sample = np.sort(table.column("fp").to_numpy().view(np.uint64))
        depth = min(math.ceil(math.log2(4 * n / leaf_most)), max(0, int(math.log2(len(sample) / 4))))
        return pa.table({"leaf": table.column("leaf")[:1], "tree": [json.dumps(build_tree(sample, depth, radius, 11))]})

    now = stored(points.select("fp").mapInArrow(first, "leaf long, above long, fp long"), "simhash-leaves")
    done, made = None, [now]
    while True:
        sizes = now.groupBy("leaf").agg(F.count("*").alias("n"), F.max("above").alias("above")).filter(F.col("n") > leaf_most)
        sizes = stored(sizes.select("leaf", "n", ((F.col("above") > 0) & (F.col("n") > STUCK * F.col("above"))).alias("stuck")), "large-leaves")
        small = now.join(sizes.select("leaf"), "leaf", "left_anti").select("leaf", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp")
        # Every two blocks together are at most about leaf_most points.
        blocks = F.ceil(F.col("n") / (leaf_most // 2)).cast("int")
        block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        split = now.join(sizes.filter("stuck"), "leaf").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).filter("block != other")
        split = split.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
        done = small.unionByName(split) if done is None else done.unionByName(small).unionByName(split)
        made.append(sizes)
        open_ = sizes.filter("not stuck").select("leaf", "n")
        if open_.isEmpty():
            return done, made
        chosen = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(LEAF_SAMPLE)) / F.col("n")) * (1 << 30)
        trees = stored(now.join(open_, "leaf").filter(chosen).select("leaf", "n", "fp").groupBy("leaf").applyInArrow(plant, "leaf long, tree string"), "leaf-trees")
        planted = open_.join(trees, "leaf", "left").select("leaf", "n", F.coalesce("tree", F.lit("[]")).alias("tree"))
        now = stored(now.drop("above").join(planted, "leaf").mapInArrow(again, "leaf long, above long, fp long"), "simhash-leaves")
        made += [trees, now]


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", radius: int = 2, leaf_most: int = LEAF_MOST) -> DataFrame:
    """rows (id_col and `fp`) with component_id: the smallest id reachable over links of at most `radius` differing bits.

    Equal fingerprints form one class first, so copies are never expanded into pairs. Distinct fingerprints are
    dealt to the leaves of a vantage-point tree whose pivots come from a sample of about PIVOT_SAMPLE of them;
    the sample shapes the tree only, every fingerprint is routed and every link is found. Boundary shells go to
    both sides. Large leaves are split further on the executors (cells_of). Cells are solved apart and give spanning
    forests; components are joined by star contraction.

    Repeated rows and ids are rows of one class; a null id is never the smallest one of a class that has another; an empty
    table gives no rows. A column named component_id is replaced.
    """
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    n = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF_ROWS)))
    # A hash of the fingerprint chooses the sample, so no more than about PIVOT_SAMPLE rows ever reach the driver.
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, PIVOT_SAMPLE / max(1, n)) * (1 << 40))
    sample = np.sort(np.array([r.fp for r in classes.select("fp").filter(chosen).collect()], np.int64)).view(np.uint64)
    tree = build_tree(sample, min(depth, max(0, int(math.log2(max(1, len(sample)) / 4)))), radius)

    def solve(table):
        import pyarrow as pa

        a, b = leaf_links(table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    cells, made = cells_of(classes, tree, radius, leaf_most)
    links = stored(cells.groupBy("leaf", "low", "high").applyInArrow(solve, "a long, b long").distinct(), "simhash-links", 2 * n)
    stars = connected(links, "a", "b")
    roots = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    linked = classes.join(roots, "fp", "left")
    least = linked.filter("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    named = stored(named, "simhash-components", n)
    for table in (*made, links, classes, stars):
        discard(table)
    return rows.drop("component_id").join(named, "fp")


# The rest serves near-copies that differ in more than a few bits. At a Jaccard similarity of 0.8 two texts' fingerprints
# differ in up to 11 of 64 bits, while distances to any vantage point spread by 4 bits only: no triangle bound prunes
# there. Candidates then come from shards of equal minimum-hash bands, and links are decided by the exact similarity of
# the whole shingle sets.

BANDS, BAND_ROWS = 25, 5
#: About so many rows, and so many bytes of shingle sets, are compared in one place. A larger shard is cut into blocks, and
#: every pair of blocks is compared.
SHARD_ROWS = 20_000
SHARD_BYTES = 64 << 20
#: Shingles of so many candidates are counted at once.
GATHERED = 1 << 22
#: A pair is a candidate if its estimate is at most so many standard errors under the similarity.
SLACK = 5.0
#: Pairs that a task sends on at a time.
PAIRS = 1 << 16
#: Bits of the table that texts meet before they move, of which the wanted ones set one each: 1 MB at most, however many they are.
FILTER_BITS = 1 << 23
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    import xxhash

    k = min(shingle, len(words))
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)


def sketch(text: bytes, shingle: int) -> tuple[int, int, bytes, np.ndarray, int]:
    """(fingerprint, key of the set of shingles, a byte per minimum hash, a key per band, size of the set) of a whole text."""
    import xxhash

    from graphmill.llm.text import space_words

    words = space_words(text)
    hashes = shingle_hashes(words, shingle)
    fp = majority(hashes) if words else 0
    unique = np.unique(hashes)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(unique), 2048):
        np.minimum(least, (unique[at : at + 2048, None] * FACTORS + OFFSETS).min(0), out=least)
    keys = np.array([xxhash.xxh64_intdigest(least[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)
    return fp, xxhash.xxh64_intdigest(unique.tobytes(), len(unique)), ((least * MIX) >> np.uint64(56)).astype(np.uint8).tobytes(), keys.view(np.int64), len(unique)


def with_sketches(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """rows with s_fp, s_set, s_mins, s_bands and s_size; null text counts as empty."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [f"k{i}" for i in range(len(rows.columns))]
    body = names[rows.columns.index(text_col)]

    def sketched(batches):
        for batch in batches:
            found = [sketch(t.as_py() or b"", shingle) for t in batch.column(body).cast(pa.binary())]
            bands = np.concatenate([x[3] for x in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(np.array([x[0] for x in found], np.uint64).view(np.int64)),
                    pa.array(np.array([x[1] for x in found], np.uint64).view(np.int64)),
                    pa.array([x[2] for x in found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(bands)),
                    pa.array([x[4] for x in found], pa.int64()),
                ],
                [*names, "s_fp", "s_set", "s_mins", "s_bands", "s_size"],
            )

    added = [("s_fp", T.LongType()), ("s_set", T.LongType()), ("s_mins", T.BinaryType()), ("s_bands", T.ArrayType(T.LongType())), ("s_size", T.LongType())]
    schema = T.StructType([*(T.StructField(n, rows.schema[c].dataType) for n, c in zip(names, rows.columns)), *(T.StructField(n, t) for n, t in added)])
    renamed = rows.select(*(F.col(c).alias(n) for n, c in zip(names, rows.columns)))
    return renamed.mapInArrow(sketched, schema).select(*(F.col(n).alias(c) for n, c in zip(names, rows.columns)), *(n for n, _ in added))


def agreeing(similarity: float, slack: float) -> float:
    """How many minimum hashes agree at that similarity, less `slack` standard errors."""
    n, p = BANDS * BAND_ROWS, similarity + (1 - similarity) / 256
    return n * p - slack * math.sqrt(n * p * (1 - p))


def shard_links(ids: np.ndarray, mins: np.ndarray, sizes: np.ndarray, similarity: float):
    """(id, id, agreeing hashes) of likely links of one shard. A search from row to row compares each with those not
    reached yet, so a tight group costs one comparison a row."""
    need = agreeing(similarity, 0)
    left = np.arange(len(ids))
    while len(left):
        head, left = left[0], left[1:]
        queue = [head]
        while queue and len(left):
            row = queue.pop()
            same = (mins[left] == mins[row]).sum(1)
            near = (same >= need) & sizes_allow(sizes[left], sizes[row], similarity)
            yield np.full(near.sum(), ids[row]), ids[left[near]], same[near]
            queue += left[near].tolist()
            left = left[~near]


def sizes_allow(sizes, size, similarity: float):
    """Whether sets of these sizes can be that similar: no more than the smaller one is shared."""
    return np.minimum(sizes, size) >= similarity * np.maximum(sizes, size) - 1e-9


def comparable(row: int, mins, sizes, group, blocks, band, bands, two: bool, need: float, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The later rows of other groups (and, of two blocks, of the other one) that the estimate doesn't rule out for a row, and how many hashes agree:
    pairs count in the first band that they share."""
    other = row + 1 + np.flatnonzero((group[row + 1 :] != group[row]) & sizes_allow(sizes[row + 1 :], sizes[row], similarity))
    if two:
        other = other[blocks[other] != blocks[row]]
    same = (mins[other] == mins[row]).sum(1)
    other, same = other[same >= need], same[same >= need]
    first = (bands[other] == bands[row]).argmax(1) == band[row]
    return other[first], same[first]


def shard_candidates(ids, mins, sizes, groups, blocks, band, bands, similarity: float):
    """(id, id, 1) of each row of one shard, or of two blocks of it, that shard_decided would have to compare with another."""
    need, bands = agreeing(similarity, SLACK), np.array(bands, np.int64)
    two, hit = len(np.unique(blocks)) > 1, np.zeros(len(ids), bool)
    for row in range(len(ids) - 1):
        other, _ = comparable(row, mins, sizes, groups, blocks, band, bands, two, need, similarity)
        hit[other] = True
        hit[row] |= len(other) > 0
    yield ids[hit], ids[hit], np.ones(int(hit.sum()), np.int64)


def shard_decided(ids, mins, sizes, groups, blocks, band, bands, hashes, similarity: float):
    """(id, id, agreeing hashes) that link the groups of one shard, or of two blocks of it, by true similarity.

    Every pair of rows in different groups that the estimate doesn't rule out is decided by the rows' whole shingle sets,
    in the first band that it shares. Groups that a link joins are one from then on, so that no more links go out than
    the shard has groups, however many pairs are compared.
    """
    need, n = agreeing(similarity, SLACK), len(ids)
    sets = [np.frombuffer(h, np.uint64) for h in hashes]
    counts = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(counts)])
    bands, group = np.array(bands, np.int64), groups.copy()
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    two = len(np.unique(blocks)) > 1
    for row in range(n - 1):
        other, same = comparable(row, mins, sizes, group, blocks, band, bands, two, need, similarity)
        mark[codes[begin[row] : begin[row + 1]]] = True
        for part in np.split(np.arange(len(other)), np.flatnonzero(np.diff(np.cumsum(counts[other]) // GATHERED)) + 1):
            part = part[group[other[part]] != group[row]]
            if not len(part):
                continue
            rows, size = other[part], counts[other[part]]
            first = np.cumsum(size) - size
            shared = np.add.reduceat(mark[codes[np.arange(int(size.sum())) + np.repeat(begin[rows] - first, size)]].astype(np.int64), first)
            for k in np.flatnonzero(shared >= similarity * (counts[row] + size - shared) - 1e-9):
                if group[rows[k]] != group[row]:
                    group[group == group[rows[k]]] = group[row]
                    yield ids[row : row + 1], ids[rows[k] : rows[k] + 1], same[part[k] : part[k] + 1]
        mark[codes[begin[row] : begin[row + 1]]] = False


def solved(rows: DataFrame, keys: list[str], columns: list[str], solve) -> DataFrame:
    """(a, b, same): what `solve` yields for the arrays of s_set, mins and `columns` of all rows of equal keys."""
    import pyarrow as pa

    def each(batches):
        key, held, out, n = None, [], [], 0

        def flush():
            a, b, same = (np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same.astype(np.int64))], ["a", "b", "same"])

        def settle():
            if len(held) > 1:
                ids, mins, *others = zip(*held)
                numbers = (x if isinstance(x[0], (bytes, list)) else np.array(x, np.int64) for x in others)
                yield from solve(np.array(ids, np.int64), np.frombuffer(b"".join(mins), np.uint8).reshape(len(ids), -1), *numbers)
            held.clear()

        def found(batch):
            nonlocal key
            for *now, row in zip(*(batch.column(c).to_pylist() for c in keys), zip(*(batch.column(c).to_pylist() for c in ("s_set", "mins", *columns)))):
                if now != key:
                    yield from settle()
                    key = now
                held.append(row)

        def everything():
            for batch in batches:
                yield from found(batch)
            yield from settle()

        for part in everything():
            if len(part[0]):
                out.append(part)
                n += len(part[0])
            if n >= PAIRS:
                yield flush()
                n = 0
        yield flush()

    return rows.select(*keys, "s_set", "mins", *columns).repartition(*keys).sortWithinPartitions(*keys, "s_set").mapInArrow(each, "a long, b long, same long")


def hash_filtered(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key none of the wanted has: a key passes where the bit of its hash is set. So few rows that an exact join
    would drop have to move to it, as long as the wanted are few beside FILTER_BITS."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    place = [F.floor(bit / 64).alias("_word"), (bit % 64).cast("int").alias("_bit")]
    words = wanted.select(*place).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.select("*", *place).join(F.broadcast(words), "_word").filter("shiftright(_bits, _bit) & 1 = 1").select(*rows.columns)


def shingle_sets(wanted: DataFrame, rows: DataFrame, classes: DataFrame, row_col: str, text_col: str, shingle: int, n: int) -> DataFrame:
    """(s_set, hashes): the sorted hashes of all shingles of the wanted ones (s_set) of n classes, from one text of each."""
    import pyarrow as pa

    from graphmill.llm.text import space_words

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(space_words(t.as_py() or b""), shingle)).tobytes() for t in batch.column("body").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("s_set"), pa.array(found, pa.binary())], ["s_set", "hashes"])

    firsts = stored(classes.select("s_set", "first_row").join(wanted.select("s_set"), "s_set", "left_semi"), "wanted-sets", n)
    texts = hash_filtered(rows.select(F.col(row_col).alias("first_row"), F.col(text_col).alias("body")), firsts, "first_row").join(firsts, "first_row")
    found = stored(texts.select("s_set", "body").mapInArrow(sets, "s_set long, hashes binary"), "shingle-sets")
    discard(firsts)
    return found


def truly_linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole shingle sets have a Jaccard similarity of at least `similarity`."""
    import pyarrow as pa

    def decided(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, name: sets.select(F.col("s_set").alias(key), F.col("hashes").alias(name))
    return stored(pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(decided, "a long, b long"), "true-links")


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """docs with d_row (a number of the row), d_group (the row number that names its group) and d_kept.

    Rows of one group are linked, in steps, by fingerprints of at most `radius` differing bits (the vantage-point tree)
    or by a Jaccard similarity of their whole shingle sets of at least `similarity`. Candidates for the latter are the
    pairs that meet in one of 25 bands of 5 minimum hashes (a pair at 0.8 is missed once in 20,000) and whose estimate
    from the 125 is not under 0.8 by more than 5 standard errors; the sets decide. First one likely link a row is
    decided, which joins most groups; then every candidate between different groups is, within its shard. Texts of one
    shingle set are one class first, so copies are never compared. The row with the smallest id of a group stays, one row
    among equal ids; null ids come last. Null text counts as empty, and texts without words are one group. An empty table
    gives no rows. Columns named d_row, d_group or d_kept are replaced; any others may have any name.
    """
    others = [c for c in docs.columns if c not in ("d_row", "d_group", "d_kept")]
    names = [f"k{i}" for i in range(len(others))]
    body = names[others.index(text_col)]
    numbered = docs.select(*(F.col(c).alias(n) for n, c in zip(names, others)), F.monotonically_increasing_id().alias("d_row"))
    rows = stored(with_sketches(numbered, body, shingle), "sketches")
    classes = rows.groupBy("s_set").agg(
        F.min("s_fp").alias("fp"), F.min("s_mins").alias("mins"), F.min("s_bands").alias("bands"), F.min("s_size").alias("size"), F.min("d_row").alias("first_row")
    )
    classes = stored(classes, "sketch-classes")
    n = classes.count()
    bands = classes.select("s_set", "size", F.posexplode("bands").alias("at", "band"))
    parts = F.greatest(F.ceil(F.count("*") / SHARD_ROWS), F.ceil(F.sum("size") * 8 / SHARD_BYTES)).cast("int")
    shared = stored(bands.groupBy("band").agg(parts.alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-bands", BANDS * n // 2)
    members = stored(bands.drop("size").join(shared, "band").withColumn("block", F.pmod(F.xxhash64("band", "s_set"), "blocks").cast("int")), "band-members", BANDS * n)
    sketches = classes.select("s_set", "mins", "size")

    likely = solved(members.join(sketches, "s_set"), ["band", "block"], ["size"], lambda *x: shard_links(*x, similarity))
    first = stored(likely.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")), "likely-links", n)
    ends = first.select("a").unionByName(first.select(F.col("b").alias("a"))).select(F.col("a").alias("s_set")).distinct()
    sets = shingle_sets(ends, rows, classes, "d_row", body, shingle, n)
    named = near_duplicates(classes.select("s_set", "fp"), "s_set", radius).filter("s_set != component_id").select(F.col("s_set").alias("a"), F.col("component_id").alias("b"))
    true = truly_linked(first, sets, similarity)
    stars = connected(true.unionByName(named), "a", "b")
    discard(sets), discard(true)

    # Shards within one group are done; the others' blocks meet each with each.
    labelled = members.join(stars.select(F.col("node").alias("s_set"), "root"), "s_set", "left").withColumn("s_group", F.coalesce("root", "s_set")).drop("root")
    labelled = stored(labelled, "labelled-members", BANDS * n)
    mixed = labelled.groupBy("band").agg(F.min("s_group").alias("low"), F.max("s_group").alias("high")).filter("low != high").select("band")
    open_ = stored(labelled.join(mixed, "band", "left_semi"), "mixed-members", BANDS * n)
    discard(members), discard(shared), discard(first)
    cells = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    cells, keys, columns = cells.join(classes.select("s_set", "mins", "size", "bands"), "s_set"), ["band", "low", "high"], ["size", "s_group", "block", "at", "bands"]
    # Whole sets go only to rows that have a candidate at all, which the sketches tell.
    able = stored(solved(cells, keys, columns, lambda *x: shard_candidates(*x, similarity)).select(F.col("a").alias("s_set")).distinct(), "candidates", n)
    sets = shingle_sets(able, rows, classes, "d_row", body, shingle, n)
    second = stored(solved(cells.join(sets, "s_set"), keys, [*columns, "hashes"], lambda *x: shard_decided(*x, similarity)).select("a", "b").distinct(), "second-links", n)
    discard(sets), discard(able), discard(labelled), discard(open_)
    before, stars = stars, connected(second.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
    grouped = rows.select("s_set", "d_row", F.col(names[others.index(id_col)]).alias("id")).join(stars.select(F.col("node").alias("s_set"), "root"), "s_set", "left").withColumn("s_group", F.coalesce("root", "s_set"))
    best = stored(
        grouped.groupBy("s_group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "d_row")).alias("best"), F.count("*").alias("n")).filter("n > 1"), "near-groups", n
    )
    losers = stored(grouped.join(best, "s_group").select("d_row", F.col("best.d_row").alias("d_best")).filter("d_row != d_best"), "near-losers", rows.count())
    for table in (classes, before, second, stars, best):
        discard(table)
    out = rows.select(*names, "d_row").join(losers, "d_row", "left")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, others)), "d_row", F.coalesce("d_best", "d_row").alias("d_group"), F.col("d_best").isNull().alias("d_kept"))
