"""Periodic runs of words: all maximal repetitions of a text, by suffix trees and Lyndon roots.

A run is a stretch of words whose smallest period ``q`` goes into it at least twice, that is at least
LEAST words long, and that no neighbouring word extends with that period.  For one text:

* Ukkonen's algorithm builds the suffix trees of the words and of their reversal; an Euler tour of
  each, with range minima over the depths at which it turns from leaf to leaf, gives the longest common extension of
  any two places to the right and to the left in constant time (lowest common ancestor of two leaves).
* Every run has a Lyndon root that is the longest Lyndon word from its place on, in the order of
  the words or in the opposite order.  That word ends before the next smaller suffix, so the order of
  leaves in the tree, walked with either order of children, gives the at most 2n roots.
* Each root is extended both ways; the repetition counts if it is at least twice the root.

Most texts have no run.  A run of period q between m and 2m words has two equal m-grams at most 2m words
apart, and so for m = 6, 12, 24, ... (the shortest runs have 12 words) every run lies inside one stretch of
overlapping pairs of that kind.  Trees are built for those stretches only, which loses no run and cuts none:
whatever a stretch's repetition could be extended by would lie in the same stretch.  Pairs are found by
hashes, so a stretch may hold no run, but every run is in a stretch.

Texts are scanned one by one in Arrow batches, without a shuffle; the memory is that of one text's
stretch (about 1.5 kB a word of it).

Defined results: a null or empty text has no runs and an empty collapsed text; null ids, repeated ids and
repeated rows each give their own row; an empty table gives no rows; other columns are carried, whatever
their names, or left out (of the carried ones, ``runs`` and ``collapsed`` give way to the result); texts are
scanned whole, whatever their length; of equally long runs the first, then the shortest period, counts as longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.llm.common import ship, word_array

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Ukkonen's tree of a list of numbers > 0; a terminal 0, smaller than all, ends it."""

    def __init__(self, word: list[int]):
        s = self.s = [*word, 0]
        n = self.n = len(s)
        start, stop, link, child = [0], [0], [0], [{}]  # the root is 0; a leaf has no children and stops at n
        node, edge, length, todo = 0, 0, 0, 0
        for i, c in enumerate(s):
            todo += 1
            last = 0
            while todo:
                if not length:
                    edge = i
                first = s[edge]
                down = child[node]
                at = down.get(first)
                if at is None:
                    down[first] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    child.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = (stop[at] if child[at] is not None else i + 1) - start[at]
                    if length >= span:
                        edge += span
                        length -= span
                        node = at
                        continue
                    if s[start[at] + length] == c:
                        if last and node:
                            link[last] = node
                        length += 1
                        break
                    split, leaf = len(start), len(start) + 1
                    start += (start[at], i)
                    stop += (start[at] + length, n)
                    link += (0, 0)
                    start[at] += length
                    child += ({s[start[at]]: at, c: leaf}, None)
                    down[first] = split
                    if last:
                        link[last] = split
                    last = split
                todo -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - todo + 1
        self.start, self.stop, self.child = start, stop, child

    def walk(self, falling: bool = False) -> tuple[list[int], list[int]]:
        """Leaves (as suffixes) in the order of the words, or with all but the terminal in falling order, and of the
        Euler tour the turns: the depth of the node where the tour turns from one leaf to the next (first: 0)."""
        start, stop, child, n = self.start, self.stop, self.child, self.n
        leaves, turns, stack = [], [], []
        at, depth, turn = 0, 0, 0
        while True:
            down = child[at]
            if down is None:
                leaves.append(start[at] - depth)  # the edge begins below the depth above it
                turns.append(turn)
                if not stack:
                    return leaves, turns
                at, depth = stack.pop()
                turn = depth
                continue
            depth += stop[at] - start[at]
            keys = sorted(down, reverse=falling)
            if falling and not keys[-1]:  # the terminal is the smallest in either order
                keys.insert(0, keys.pop())
            for k in keys[:0:-1]:
                stack.append((down[k], depth))
            at = down[keys[0]]


def ranked(leaves: list[int]) -> np.ndarray:
    """Each suffix's place among the leaves."""
    rank = np.empty(len(leaves), np.int64)
    rank[leaves] = np.arange(len(leaves))
    return rank


class CommonExtension:
    """Length of the longest common prefix of two suffixes: the depth of their leaves' lowest common ancestor, which is
    the least turn of the Euler tour between them.  Range minima by blocks, in constant time."""

    BLOCK = 16

    def __init__(self, leaves: list[int], turns: list[int]):
        b = self.BLOCK
        d = np.asarray(turns, np.int32)
        d = np.concatenate([d, np.full(-len(d) % b, np.iinfo(np.int32).max, np.int32)]).reshape(-1, b)
        self.rank = ranked(leaves)
        self.turns = d.ravel()
        self.from_left = np.minimum.accumulate(d, axis=1).ravel()
        self.from_right = np.minimum.accumulate(d[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [d.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(d):
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j of the text."""
        b = self.BLOCK
        x, y = self.rank[i], self.rank[j]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y)
        low, high = x // b, y // b
        out = np.minimum(self.from_right[x], self.from_left[y])
        gap = high - low - 1
        for k, level in enumerate(self.levels):
            here = np.flatnonzero(gap >> k == 1)
            out[here] = np.minimum(out[here], np.minimum(level[low[here] + 1], level[high[here] - (1 << k)]))
        near = np.flatnonzero(gap < 0)
        if len(near):
            span = np.minimum(x[near, None] + np.arange(b), y[near, None])
            out[near] = self.turns[span].min(axis=1)
        return out


def _longest_lyndon(leaves: list[int], n: int) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: the next smaller suffix."""
    rank = ranked(leaves).tolist()
    ends, open_ = [n] * n, []
    for i, r in enumerate(rank[:n]):
        while open_ and rank[open_[-1]] > r:
            ends[open_.pop()] = i
        open_.append(i)
    return np.asarray(ends, np.int64)


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of numbers > 0, in order."""
    n = len(word)
    if n < 2:
        return []
    tree = SuffixTree(word)
    rising, turns = tree.walk()
    falling = tree.walk(falling=True)[0]
    del tree
    right = CommonExtension(rising, turns)
    left = CommonExtension(*SuffixTree(word[::-1]).walk())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_longest_lyndon(rising, n), _longest_lyndon(falling, n)])
    period = j - i
    ahead, behind = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    some = np.flatnonzero(j < n)
    ahead[some] = right(i[some], j[some])
    some = np.flatnonzero(i > 0)
    behind[some] = left(n - i[some], n - j[some])
    start, stop = i - behind, j + ahead
    good = stop - start >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[good], period[good], stop[good]], axis=1), axis=0)
    return [(s, e - s, p) for s, p, e in found.tolist()]


def _grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m-grams, from ``h`` of single words, by doubling."""
    out, size = h, 1
    while size < m:
        step = min(size, m - size)
        a, b = out[:-step], out[step:]
        out = (a ^ (b << np.uint64(23) | b >> np.uint64(41))) * _MIX
        out ^= out >> np.uint64(31)
        size += step
    return out


def stretches(words: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [first, last) of the text that hold all of its runs."""
    m = least // 2
    if len(words) < least:
        return []
    codes = np.fromiter(map(crc32, words), np.uint64, len(words)) * _MIX
    grams = _grams(codes, m)
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    covered = np.zeros(len(words) + 1, np.int64)
    while len(grams) > m:
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        same = np.flatnonzero(g[1:] == g[:-1])
        if not len(same):
            break
        at, following = order[same], order[same + 1]
        near = following - at <= 2 * m
        np.add.at(covered, at[near], 1)
        np.add.at(covered, following[near] + m, -1)
        grams = _grams_of_pairs(grams, m)
        m *= 2
    inside = np.cumsum(covered[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _grams_of_pairs(grams: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the 2m-grams from those of the m-grams."""
    a, b = grams[:-m], grams[m:]
    out = (a ^ (b << np.uint64(23) | b >> np.uint64(41))) * _MIX
    return out ^ out >> np.uint64(31)


def runs_in(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    out = []
    for first, last in stretches(words, least):
        known: dict[bytes, int] = {}
        codes = [known.setdefault(w, len(known) + 1) for w in words[first:last]]
        out += [(first + s, length, p) for s, length, p in runs_of(codes, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def scan(docs: DataFrame, carry: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` (with ``text``): the columns to carry (default: all), ``runs`` (an array of ``start``, ``length``,
    ``period`` in words, by start, then period) and ``collapsed`` (the text's words without the repeats, one space between)."""
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("runs", "collapsed")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text")
    schema = T.StructType([row.schema["_row"], T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                runs = runs_in(words, least)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(found, run), pa.array(kept, pa.binary()).cast(pa.string())], ["_row", "runs", "collapsed"])

    ship(docs.sparkSession)
    told = row.mapInArrow(find, schema)
    return told.select(*[F.col("_row").getField(c).alias(c) for c in columns], "runs", "collapsed")


def longest(runs: str | Column) -> Column:
    """The longest run (ties: first start, then shortest period), or null."""
    c = F.col(runs) if isinstance(runs, str) else runs
    key = F.transform(c, lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"),
                                            r["length"].alias("length")))
    return F.array_min(key)


def damaged(doc_id: str, text: Column) -> Column:
    """The text with a planted run for one id in ten: h is the crc32 of the id as text (null: empty), g = h div 10;
    if 10 divides h, each of the n words from a = g mod n on repeats the p words there, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))

    def planted(s):
        words, g = s["words"], s["g"]
        n = F.size(words)
        bound = F.element_at(F.transform(F.array(F.struct(words.alias("words"), (g % n).cast("int").alias("a"), g.alias("g"), n.alias("n"))), lambda t: F.struct(
            t["words"].alias("words"), t["a"].alias("a"),
            (1 + F.floor((t["n"] - t["a"]) / (3 + t["g"] % 8))).cast("int").alias("p"))), 1)
        return F.array_join(F.element_at(F.transform(F.array(bound), lambda t: F.transform(
            t["words"], lambda w, i: F.when(i < t["a"], w).otherwise(F.get(t["words"], (t["a"] + (i - t["a"]) % t["p"]).cast("int"))))), 1), " ")

    parts = F.struct(word_array(text).alias("words"), F.floor(h / 10).alias("g"))
    made = F.element_at(F.transform(F.array(parts), lambda s: F.when(F.size(s["words"]) > 0, planted(s)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, made).otherwise(text)
