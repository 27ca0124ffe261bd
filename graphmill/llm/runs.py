"""Periodic runs of words: Crochemore's partition refinement over equal-factor classes of positions."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.lm import mixed
from graphmill.llm.text import pieces

LEAST_LENGTH = 24
LEAST_POWER = 3
#: Words of texts that are refined together.
WORDS_AT_ONCE = 1_000_000
#: A third of the least length: a run holds two equal factors of so many words.
FACTOR = LEAST_LENGTH // LEAST_POWER


def covered(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True for words inside a factor of FACTOR words that occurs again in its group (or shares a 64-bit hash with one)."""
    n = len(symbols) - FACTOR + 1
    inside = np.zeros(len(symbols), bool)
    if n <= 1:
        return inside
    h = mixed(symbols.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
    h ^= mixed(group[:n].astype(np.uint64))
    whole = np.flatnonzero(group[:n] == group[FACTOR - 1 :])
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    edge = np.zeros(len(symbols) + 1, np.int32)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(edge, again, 1)
    np.add.at(edge, again + FACTOR, -1)
    inside[:] = np.cumsum(edge[:-1]) > 0
    return inside


def stretches(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words that may hold a run; each run lies inside one.

    Any FACTOR words of a run occur again in it, so it is covered by factors that recur in its text, and again by those
    that recur in that stretch. What is left out holds no run.
    """
    first, end = np.array([0]), np.array([len(symbols)])
    inside = np.ones(len(symbols), bool)
    for _ in range(3):
        at = np.flatnonzero(inside)
        inside[at] = covered(symbols[at], group[at])
        at = np.flatnonzero(inside)
        cut = np.flatnonzero((np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]])) if len(at) else np.empty(0, np.int64)
        first, end = at[np.concatenate([[0], cut + 1])] if len(at) else at, at[np.concatenate([cut, [-1]])] + 1 if len(at) else at
        long = end - first >= LEAST_LENGTH
        first, end, before = first[long], end[long], len(at)
        inside[:] = False
        group = group.copy()
        for k, (a, b) in enumerate(zip(first, end)):
            inside[a:b] = True
            group[a:b] = k
        if inside.sum() > 0.9 * before:
            break
    return first, end


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Refinement:
    """Classes of positions that start equal factors of one length, refined by one word at a time.

    Texts stand end to end, each with an end mark of its own. A class is a slice of `member`, and a list in order of
    position through `following` and `before`. A class splits by the classes of its members' next positions; of the
    parts that a class has split into, all but the largest need to be looked at for the next length, so a position
    is moved at most log2(n) times. Neighbours in a class whose distance equals the length are the two halves of a
    square without a shorter period.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        """symbols: of all texts end to end, without marks; sizes: words of each text."""
        n = len(symbols) + len(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.offset = np.cumsum(sizes + 1) - sizes - 1
        marked = np.full(n, -1, np.int64)
        marked[spread(self.offset, sizes)] = symbols
        #: The longest period that a run of the position's text can have.
        self.longest = np.repeat(sizes // LEAST_POWER, sizes + 1)
        self.length = 1
        order = np.lexsort((marked, text))
        new = np.concatenate([[True], (marked[order][1:] != marked[order][:-1]) | (text[order][1:] != text[order][:-1])])
        self.member, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.kind = np.empty(n, np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.start, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        begin = np.flatnonzero(new)
        self.kinds = len(begin)
        self.start[: self.kinds], self.size[: self.kinds] = begin, np.diff(np.append(begin, n))
        linked = ~new[1:]
        self.following, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.following[order[:-1][linked]], self.before[order[1:][linked]] = order[1:][linked], order[:-1][linked]
        # All classes of a text are parts of one; the largest is left out.
        of = text[order[begin]]
        by_size = np.lexsort((self.size[: self.kinds], of))
        largest = by_size[np.append(np.flatnonzero(np.diff(of[by_size])), len(by_size) - 1)]
        small = np.ones(self.kinds, bool)
        small[largest] = False
        self.small = np.flatnonzero(small[self.kind])
        self.moved = np.empty(0, np.int64)
        self.mark = np.zeros(n, bool)

    def refine(self) -> None:
        """From factors of `length` words to factors of one word more; `moved` are positions with another follower than before."""
        self.length += 1
        at = self.small - 1
        fits = (at >= 0) & (self.size[self.kind[at]] > 1) & (self.longest[at] >= self.length)
        at, by = at[fits], self.kind[self.small[fits]]
        own = self.kind[at]
        order = np.lexsort((at, by, own))
        at, by, own = at[order], by[order], own[order]
        self.small = self.moved = np.empty(0, np.int64)
        if not len(at):
            return
        new_kind = np.concatenate([[True], own[1:] != own[:-1]])
        begin = np.flatnonzero(new_kind | np.concatenate([[True], by[1:] != by[:-1]]))
        parts = np.diff(np.append(begin, len(at)))
        # Of each class: its first part, how many parts, moved members, and the rest.
        lead = np.flatnonzero(new_kind[begin])
        n_parts = np.diff(np.append(lead, len(begin)))
        olds = own[begin[lead]]
        rest = self.size[olds] - np.add.reduceat(parts, lead)
        split = (rest > 0) | (n_parts > 1)
        if not split.any():
            return
        keep = np.repeat(split, n_parts)
        owner = np.repeat(np.arange(len(olds)), n_parts)
        at, begin, parts, owner = at[np.repeat(keep, parts)], None, parts[keep], owner[keep]
        # The largest part of each class, the first of equals.
        by_size = np.lexsort((-np.arange(len(parts)), parts, owner))
        last = by_size[np.append(np.flatnonzero(np.diff(owner[by_size])), len(by_size) - 1)]
        largest = np.zeros(len(parts), bool)
        largest[last] = True
        whole = rest[owner] == 0
        stays = largest & whole
        small = ~(largest & (parts > rest[owner]))
        moves = ~stays
        at = at[np.repeat(moves, parts)]
        parts, owner, small = parts[moves], owner[moves], small[moves]
        old = olds[owner]
        named = self.kinds + np.arange(len(parts))
        self.kinds += len(parts)
        part = np.repeat(np.arange(len(parts)), parts)
        # Out of the old lists: moved members that follow each other go together.
        line = np.argsort(at + np.repeat(owner, parts) * len(self.kind), kind="stable")
        inline = at[line]
        joined = self.following[inline[:-1]] == inline[1:]
        firsts, lasts = inline[np.concatenate([[True], ~joined])], inline[np.concatenate([~joined, [True]])]
        left, right = self.before[firsts], self.following[lasts]
        self.following[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        # Into the new ones.
        same = part[1:] == part[:-1]
        self.following[at], self.before[at] = -1, -1
        self.following[at[:-1][same]], self.before[at[1:][same]] = at[1:][same], at[:-1][same]
        # Moved members take the front of their class's slice.
        lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        taken = np.add.reduceat(parts, lead)
        fronts = self.start[old[lead]]
        slots = spread(fronts, taken)
        self.mark[at] = True
        there = self.member[slots]
        out = there[~self.mark[there]]
        free = self.place[at]
        free = free[free >= np.repeat(fronts + taken, taken)]
        self.member[free], self.place[out] = out, free
        self.member[slots], self.place[at] = at, slots
        self.mark[at] = False
        self.kind[at] = named[part]
        ends = np.cumsum(parts)
        self.start[named] = slots[ends - parts]
        self.size[named] = parts
        self.start[old[lead]] += taken
        self.size[old[lead]] -= taken
        # The rest of a class counts as small where a moved part is larger.
        biggest = np.maximum.reduceat(parts, lead)
        rest = old[lead][(rest[owner[lead]] > 0) & (rest[owner[lead]] < biggest)]
        self.small = np.concatenate([at[np.repeat(small, parts)], self.member[spread(self.start[rest], self.size[rest])]])
        self.moved = np.concatenate([at, left[left >= 0]])


def runs_of(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts that stand end to end, in order of text, start and period.

    A run's positions but for its last two periods start squares of its period, each found at that length.
    """
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    if not len(sizes):
        return (np.empty(0, np.int64),) * 4
    state, due = Refinement(symbols, sizes), {}

    def expect(at: np.ndarray, least: int, end: int) -> None:
        """Notes positions whose distance to the next of their class is from least up to end."""
        gap = state.following[at] - at
        fits = (gap >= least) & (gap < end) & (gap <= state.longest[at])
        at, gap = at[fits], gap[fits]
        order = np.argsort(gap, kind="stable")
        at, gap = at[order], gap[order]
        cut = np.flatnonzero(np.diff(gap)) + 1
        for g, held in zip(gap[np.concatenate([[0], cut])] if len(gap) else (), np.split(at, cut)):
            due.setdefault(int(g), []).append(held)

    most, end = int(state.longest.max()), 1
    while state.length <= most:
        if state.length == end:
            end *= 2
            due = {}
            expect(np.flatnonzero(state.following >= 0), state.length, end)
        else:
            expect(state.moved, state.length, end)
        q = state.length
        if q in due:
            at = np.unique(np.concatenate(due.pop(q)))
            at = at[state.following[at] - at == q]
            if len(at):
                cut = np.flatnonzero(np.diff(at) != 1)
                first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [-1]])]
                long = last - first + 2 * q >= max(LEAST_LENGTH, LEAST_POWER * q)
                if long.any():
                    found.append((first[long], (last - first + 2 * q)[long], q))
        if not len(state.small):
            break
        state.refine()
    if not found:
        return (np.empty(0, np.int64),) * 4
    first, length = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    period = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    text = np.searchsorted(state.offset, first, side="right") - 1
    return text, first - state.offset[text], length, period


def runs_in(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text, given as words, its runs (start, length, period) by start, then period."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.concatenate([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]) if texts else np.empty(0, np.int64)
    first, end = stretches(symbols, np.repeat(np.arange(len(texts)), sizes))
    k, start, length, period = runs_of(symbols[spread(first, end - first)], end - first)
    start = first[k] + start
    begin = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, *run in zip((np.searchsorted(begin, start, side="right") - 1).tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append((run[0] - int(begin[d]), run[1], run[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its periodic runs, the one of greatest exponent, and the text with each run cut to one period.

    Words are runs of anything but tab, line feed, vertical tab, form feed, carriage return and space. A run is a
    stretch of words of smallest period q, of max(24, 3q) words or more, that no neighbouring word extends with that
    period. `best` has the greatest exact length / period; of equals the one that starts first, then the one of the shorter period;
    null where there is no run. `collapsed` holds the words that no run contains after its first q words, joined by
    one space. Texts are worked on whole, several together in a task; there is no shuffle. Null and empty texts have
    no words and no runs; ids may be null or repeat; other columns are not read; an empty table gives no rows.

    Columns: id_col, n_words, runs (array of start, length, period, by start, then period), best, collapsed.
    """
    import pyarrow as pa

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def emit(ids, texts):
        found = runs_in(texts)
        as_rows = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        best = [max(rows, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if rows else None for rows in as_rows]
        short = [b" ".join(collapsed(t, r) if r else t).decode() for t, r in zip(texts, found)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(as_rows, pa.list_(run)), pa.array(best, run), pa.array(short, pa.string())], ["id", "n_words", "runs", "best", "collapsed"]
        )

    def work(batches):
        for batch in batches:
            for begun, held in pieces((t.as_py() for t in batch.column("text").cast(pa.binary())), 16 << 20):
                texts, size, at = [], 0, begun
                for text in held:
                    words = text.split()
                    if texts and size + len(words) > WORDS_AT_ONCE:
                        yield emit(batch.column("id").slice(at, len(texts)), texts)
                        texts, size, at = [], 0, at + len(texts)
                    texts.append(words)
                    size += len(words)
                yield emit(batch.column("id").slice(at, len(texts)), texts)

    one = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(one)), T.StructField("best", one), T.StructField("collapsed", T.StringType())]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
