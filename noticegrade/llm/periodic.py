"""Stretches of a text that repeat with a period, by joining suffix classes in the order of their LCP.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that
no neighbouring word extends. It's found from the suffixes at its start s and at s + q, which
share exactly its length less q words.

Suffixes are sorted (prefix doubling, for many documents at once), neighbours in that order
are edges with their longest common prefix (LCP), and edges are taken from the largest LCP down,
as in Kruskal's algorithm: a union-find joins classes of suffixes, each with the ordered set of
its positions. When two classes meet at LCP l, positions i < j that become neighbours agree in
exactly l words; if j - i is within what l allows, they seed the run from i to j + l, provided
that the words before them differ. No position of the class lies between s and s + q (a smaller
period would follow), so every run is seeded. A pair that a later union of the same l separates
may seed the same stretch with a multiple of its period; the smallest is kept.

Words are compared as they are, without hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticegrade.llm.words import slices, small_batches, text_buffers

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Positions that an ordered set keeps in one list.
_BLOCK = 4096

RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


class Positions:
    """An ordered set of positions in blocks, so that a very large one takes new members cheaply."""

    def __init__(self, first: int) -> None:
        self.size, self.blocks, self.tops = 1, [[first]], [first]

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x`` in; the members next to it, before and after."""
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at] if at < len(block) else None
        block.insert(at, x)
        self.size += 1
        self.tops[k] = block[-1]
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.tops[k : k + 1] = [block[_BLOCK - 1], block[-1]]
        return before, after


def suffix_classes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes, LCP of each with the one before it).

    Only positions that share their first words with another one are in it: all that share
    ``least`` words are. ``words`` are numbers; suffixes end with the array.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    # a class's rank is the number of suffixes before it, so finer ranks fit in between
    rank = np.concatenate([[0], np.cumsum(np.bincount(rank))])[rank] if n else rank
    levels, active, step, kept = [rank], np.arange(n), 1, None
    while len(active):
        if kept is None and 2 * step > least:
            kept = active
        padded = np.concatenate([rank, np.full(step, -1)])
        key = rank[active] * (n + 1) + padded[active + step] + 1
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], rank[active[order]]
        at = np.arange(len(active))
        head = np.ones(len(active), bool)
        head[1:] = old[1:] != old[:-1]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = old + start - first
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        active, step = active[~alone], 2 * step
    if kept is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = kept[np.argsort(rank[kept], kind="stable")]
    lcp = np.zeros(len(places), np.int64)
    left, right = places[:-1], places[1:]
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + lcp[1:], right + lcp[1:]
        inside = np.maximum(a, b) < n
        level = levels[k]
        same = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
        lcp[1:] += same.astype(np.int64) << k
    return places, lcp


def find_runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``least_words`` and ``least_exponent`` periods or more, in order."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    least = max(1, min(max(least_words, least_exponent * q) - q for q in range(1, max(least_words, 1) + 1)))
    places, lcp = suffix_classes(words, least)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    place = places.tolist()

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    seeds = []
    for e, l in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(e - 1), root(e)
        large = sets.pop(a, None) or Positions(place[a])
        small = sets.pop(b, None) or Positions(place[b])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        most = l // (least_exponent - 1)
        last = None
        for x in small:
            before, after = large.add(x)
            # neighbours that both come from the smaller set agree in more words than l
            if before is not None and before != last and x - before <= most:
                seeds.append((before, x, l))
            if after is not None and after - x <= most:
                seeds.append((x, after, l))
            last = x
        parent[b] = a
        sets[a] = large
    found: dict[tuple[int, int], int] = {}
    for i, j, l in seeds:
        q = j - i
        if q + l >= max(least_words, least_exponent * q) and (i == 0 or words[i - 1] != words[j - 1]):
            found[i, j + l] = min(q, found.get((i, j + l), q))
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """All words as numbers that differ from text to text, so that no common prefix leaves a text."""
    out: list[int] = []
    base = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
    return np.array(out, np.int64)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _finder(least_words: int, least_exponent: int, names: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_buffers(batch.column("text"))
            n_words, runs, texts = [], [], []
            for low, high in slices(offsets):
                raw, limits = data[offsets[low] : offsets[high]].tobytes(), (offsets[low : high + 1] - offsets[low]).tolist()
                words = [raw[a:b].split() for a, b in zip(limits[:-1], limits[1:], strict=True)]
                sizes = [len(w) for w in words]
                begin = np.concatenate([[0], np.cumsum(sizes)])
                own: list[list[tuple[int, int, int]]] = [[] for _ in words]
                for start, length, period in find_runs(_numbered(words), least_words, least_exponent):
                    k = int(np.searchsorted(begin, start, "right")) - 1
                    own[k].append((start - int(begin[k]), length, period))
                n_words += sizes
                runs += own
                texts += [b" ".join(_kept(w, r)) for w, r in zip(words, own, strict=True)]
            flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in runs])]), pa.int32()), spans)
            columns = [pa.array(n_words, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns], names=[*names, "n_words", "runs", "collapsed"])

    return find


def periodic_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_words, runs and collapsed.

    ``runs`` lists start, length and period (in words, from 0) of each stretch with
    ``least_words`` words and ``least_exponent`` (2 or more) periods at least that no neighbouring
    word extends, by start, then period. ``collapsed`` has the text's words joined by one space,
    without those that a run holds after its first period.

    Words stand between white space of ASCII and are told apart by case. A null, empty or blank
    text has no words, no runs and an empty ``collapsed``. Every row is handled by itself, so rows
    that repeat give equal results; a text of any length is taken whole. Columns of ``docs`` with
    the name of an added one are replaced.
    """
    added = ("n_words", "runs", "collapsed")
    names = [c for c in keep or docs.columns if c not in added]
    text = F.col("text").cast("string").alias("text")
    read = docs.select(*(F.col(c) for c in names if c != "text"), text)
    out = T.StructType([read.schema[c] for c in names])
    out = out.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    return read.mapInArrow(_finder(least_words, least_exponent, names), out)
