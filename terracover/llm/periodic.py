"""Periodic runs of words: longest previous factors, their blocks, Main's extensions and copied runs.

A run is a stretch of words with smallest period q, of at least max(min_length, 2 q) words, that no
neighbouring word extends with period q. The words of many texts lie in one array, each text with
symbols of its own, so that nothing reaches over a text's end:

* prefix doubling sorts the suffixes; the ranks of each round tell whether stretches of 2^k words are
  equal, which gives the common prefixes of neighbours (LCP) and, later, of any two places;
* the longest previous factor of a place is the better of its nearest smaller places in the suffix
  order, found for all places at once by pointer jumping with minima of the LCP;
* the factors cut each text into blocks. A run that touches the boundary before the block it ends in
  has a period below the lengths of both blocks together, and is found by extending the boundary with
  that period to both sides (Main); boundaries whose blocks are too short for min_length are left out;
* every other run lies inside a block and is copied, in the order of starts, from the block's earlier place.

Defined results: null and empty texts have no words and no runs; repeated rows each appear; a null
doc_id appears; very long texts are one block of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of texts that are worked on at once; a longer text is alone.
BLOCK = 1 << 18


class Suffixes:
    """Suffix order, ranks by 2^k words and longest previous factors of several texts in one array."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        """symbols: word numbers, text after text; sizes: words of each text."""
        n = self.n = len(symbols)
        self.cuts = np.r_[0, np.cumsum(sizes)]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.end = self.cuts[1:][self.doc]
        self._sort(self.doc * (int(symbols.max(initial=0)) + 1) + symbols)
        self._factors()
        del self.order, self.level
        self.levels = self.levels[:-1] or self.levels  # of the last round all ranks differ
        assert n == len(self.lpf)

    def _sort(self, key: np.ndarray) -> None:
        n = self.n
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = first
        self.levels = [rank]
        level = np.where(new, 0, -1).astype(np.int8)  # the round that told a place from the one before it
        slots, width = np.arange(n), 1
        while True:
            own = new[slots] & np.r_[new[slots[1:]], True]
            slots = slots[~own]
            if not len(slots):
                break
            places = order[slots]
            then = places + width
            second = np.where(then < self.end[places], rank[np.minimum(then, n - 1)] + 1, 0)
            pair = first[slots] * (n + 1) + second
            by = np.argsort(pair, kind="stable")
            order[slots] = places = places[by]
            pair = pair[by]
            fresh = np.r_[True, pair[1:] != pair[:-1]]
            level[slots[fresh & ~new[slots]]] = len(self.levels)
            new[slots] = fresh
            first[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
            rank = rank.copy()
            rank[places] = first[slots]
            self.levels.append(rank)
            width *= 2
        self.order, self.level = order, level

    def _factors(self) -> None:
        """lpf: longest stretch from each place that begins earlier too; source: where."""
        n, order = self.n, self.order
        lcp = np.zeros(n + 1, np.int32)
        for t in range(len(self.levels) - 1, -1, -1):
            at = np.flatnonzero(self.level > t)
            a, b = order[at - 1] + lcp[at], order[at] + lcp[at]
            fits = np.maximum(a, b) < self.end[order[at]]
            same = fits & (self.levels[t][np.minimum(a, n - 1)] == self.levels[t][np.minimum(b, n - 1)])
            lcp[at[same]] += 1 << t
        self.lpf, self.source = np.zeros(n, np.int32), np.full(n, -1)
        for step, low in ((-1, lcp[:-1].copy()), (1, lcp[1:].copy())):
            to = np.arange(n) + step
            live = np.flatnonzero(low > 0)
            while len(live):
                live = live[(low[live] > 0)]
                live = live[order[to[live]] > order[live]]
                via = to[live]
                low[live], to[live] = np.minimum(low[live], low[via]), to[via]
            better = np.flatnonzero(low > self.lpf[order])
            self.lpf[order[better]] = low[better]
            self.source[order[better]] = order[to[better]]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from places a < b on, within b's text (b may be its end)."""
        out, end = np.zeros(len(a), np.int64), self.end[np.minimum(a, self.n - 1)]
        for t in range(len(self.levels) - 1, -1, -1):
            i, j = a + out, b + out
            rank = self.levels[t]
            out += ((j < end) & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)])).astype(np.int64) << t
        return out

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Equal words up to places a < b, within the text that begins at `begin` (a may be before it)."""
        out = np.zeros(len(a), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            i, j = a - out - (1 << t) + 1, b - out - (1 << t) + 1
            rank = self.levels[t]
            out += ((i >= begin) & (rank[np.maximum(i, 0)] == rank[np.maximum(j, 0)])).astype(np.int64) << t
        return out


def _blocks(s: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks of texts that can have a run: one whose second half, of least / 2 words or more, occurs before."""
    length = np.maximum(s.lpf, 1).tolist()
    starts: list[int] = []
    for k in np.unique(s.doc[s.lpf >= least // 2]).tolist():
        at, end = int(s.cuts[k]), int(s.cuts[k + 1])
        while at < end:
            starts.append(at)
            at += length[at]
    out = np.array(starts, np.int64)
    return out, np.maximum(s.lpf[out], 1).astype(np.int64)


def _touching(s: Suffixes, starts: np.ndarray, lengths: np.ndarray, least: int, pairs: int = 1 << 20) -> set[tuple[int, int, int]]:
    """(start, end, period) of runs that touch a boundary of blocks, texts' ends included."""
    doc = s.doc[starts]
    last = np.r_[doc[1:] != doc[:-1], True]
    # boundaries: before each block but a text's first, and after each text's last block
    inner = np.flatnonzero(~np.r_[True, last[:-1]])
    at = np.r_[starts[inner], starts[last] + lengths[last]]
    before = np.r_[lengths[inner - 1], lengths[last]]
    after = np.r_[lengths[inner], np.zeros(int(last.sum()), np.int64)]
    begin = s.cuts[np.r_[doc[inner], doc[last]]]
    use = before + after >= least // 2
    at, before, after, begin = at[use], before[use], after[use], begin[use]
    one = s.levels[0]
    found: dict[tuple[int, int], int] = {}
    for left in (False, True):
        size = np.minimum(before + after - 1, at - begin) if left else np.maximum(after - 1, 0)
        chunk = np.cumsum(size) // pairs
        for c in np.unique(chunk).tolist():
            own = np.flatnonzero((chunk == c) & (size > 0))
            k = np.repeat(own, size[own])
            period = np.arange(len(k)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + 1
            b, end = at[k], s.cuts[s.doc[begin[k]] + 1]
            i, j = (b - period, b) if left else (b, b + period)
            near = (j < end) & (one[np.minimum(i, s.n - 1)] == one[np.minimum(j, s.n - 1)])
            near |= (i > begin[k]) & (one[np.maximum(i - 1, 0)] == one[j - 1])
            i, j, period, begins = i[near], j[near], period[near], begin[k][near]
            f, g = s.forward(i, j), s.backward(i - 1, j - 1, begins)
            good = (f + g >= period) & (f + g + period >= least)
            for st, en, p in zip((i - g)[good].tolist(), (j + f)[good].tolist(), period[good].tolist(), strict=True):
                if p < found.get((st, en), 1 << 62):
                    found[st, en] = p
    return {(st, en, p) for (st, en), p in found.items()}


def _copied(s: Suffixes, starts: np.ndarray, lengths: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """All runs in order, those inside of a block taken over from its earlier place; runs: those that touch a boundary, in order."""
    known = set(runs)
    for at, size in zip(starts[lengths > least].tolist(), lengths[lengths > least].tolist(), strict=True):
        first = int(s.source[at])
        shift, end = at - first, first + size
        k = bisect_right(runs, (first, 1 << 62, 0))
        while k < len(runs) and runs[k][0] < end:
            st, en, p = runs[k]
            new = (st + shift, en + shift, p)
            if en < end and new not in known:
                known.add(new)
                insort(runs, new)
            k += 1
    return runs


def runs_of(texts: list[list[bytes]], min_length: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    s = Suffixes(np.fromiter((ids[w] for t in texts for w in t), np.int64, int(sizes.sum())), sizes)
    starts, lengths = _blocks(s, min_length)
    if len(starts):
        for st, en, p in _copied(s, starts, lengths, sorted(_touching(s, starts, lengths, min_length)), min_length):
            k = int(s.doc[st])
            out[k].append((st - int(s.cuts[k]), en - st, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blanks, tabs and line ends."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words, without those that a run has after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for st, size, p in runs:
        depth[st + p] += 1
        depth[st + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _each(texts: Iterator[str | None], min_length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text, in order."""
    held: list[list[bytes]] = []
    size = 0
    for t in texts:
        words = words_of(t)
        if held and size + len(words) > BLOCK:
            yield from zip(held, runs_of(held, min_length), strict=True)
            held, size = [], 0
        held.append(words)
        size += len(words)
    yield from zip(held, runs_of(held, min_length), strict=True)


def _texts(docs: DataFrame) -> DataFrame:
    """Ids as text, as pandas would make floats of longs with nulls."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _with_ids(made: DataFrame) -> DataFrame:
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """(doc_id, start, length, period): one row per run of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [own for _, own in _each(iter(b["text"]), min_length)]
            at = np.repeat(np.arange(len(b)), [len(own) for own in found])
            yield pd.DataFrame([r for own in found for r in own], columns=["start", "length", "period"]).assign(doc_id=b["doc_id"].to_numpy()[at])

    return _with_ids(_texts(docs).mapInPandas(run, "doc_id string, start long, length long, period long"))


def collapsed(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """The documents, all columns, each text without the repeats of its runs; texts without a run stay as they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([b" ".join(without_repeats(words, own)).decode("utf-8", "surrogatepass") if own else t for t, (words, own) in zip(b, _each(iter(b), min_length), strict=True)], dtype=object)

    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string")))


def _row(words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in own)
    return len(own), start, length, period, 1000 * length // period if own else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(without_repeats(words, own))).hexdigest()


def digest(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the longest run; runs_sha256, collapsed_sha256."""
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([_row(words, own) for words, own in _each(iter(b["text"]), min_length)], columns=columns)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.astype({c: "Int64" for c in columns[:5]})

    return _with_ids(_texts(docs).mapInPandas(run, "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"))
