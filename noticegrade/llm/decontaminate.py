"""Benchmark contamination of training documents, by suffix arrays of the training text.

Each task takes its documents in shards of about a megabyte, builds the suffix array of the
shard's words, and binary-searches every suffix of every benchmark item in it. A window is an
item's next ``window`` words (an item that is shorter is one window); neighbouring windows on
one diagonal make up the longest verbatim matches, with their places.

A suffix can only match if its first words all occur in the benchmark, so the array is kept
for those suffixes alone and stays small beside the text.

The benchmark goes to the tasks in chunks of a bounded size, one pass over the documents for
each chunk (one in all for usual benchmarks). A pass adds to what the one before has marked and
written; driver and tasks hold one chunk at a time, whatever the size of the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticegrade.functions.storage import settle
from noticegrade.llm.words import ALPHANUMERIC, slices, small_batches, text_buffers, word_hashes

WINDOW = 13
#: Bytes of benchmark text that a pass sends to the tasks.
CHUNK_BYTES = 16 << 20

_MARKS = T.StructType().add("hit_from", T.ArrayType(T.IntegerType())).add("hit_to", T.ArrayType(T.IntegerType()))
_MARKS = _MARKS.add("items", T.ArrayType(T.StringType())).add("longest", T.IntegerType())
_MARKS = _MARKS.add("longest_at", T.IntegerType()).add("longest_item", T.StringType()).add("n_words", T.LongType())


class Windows:
    """The distinct windows of benchmark items, with where each occurs."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        data, offsets = text_buffers(pa.array([text for _, text in items], pa.string()))
        hashes, rows, _ = word_hashes(data, offsets, ALPHANUMERIC)
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary = np.unique(hashes)
        ids = self.ids(hashes)
        sizes = np.diff(rows)
        self.shortest = int(min((min(n, window) for n in sizes if n), default=0))
        starts, width, item, at = [], [], [], []
        for k, (low, n) in enumerate(zip(rows[:-1], sizes, strict=True)):
            if n:
                w = min(n, window)
                here = np.arange(n - w + 1)
                starts.append(low + here)
                width.append(np.full(len(here), w))
                item.append(np.full(len(here), k))
                at.append(here)
        none = [np.zeros(0, np.int64)]
        starts, width, item, at = (np.concatenate(x or none) for x in (starts, width, item, at))
        own = keys(np.concatenate([ids, np.zeros(window, np.int32)]), starts, width, window)
        # each distinct window once, and the list of its places
        self.keys, which = np.unique(own, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.place_from = np.searchsorted(which[order], np.arange(len(self.keys) + 1))
        self.item, self.at = item[order], at[order]
        first = order[self.place_from[:-1]]
        self.width = width[first]
        # the largest key that begins with the window's words
        tail = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(len(self.keys), 4 * window).copy()
        tail[np.arange(4 * window)[None, :] >= 4 * self.width[:, None]] = 255
        self.upper = tail.reshape(-1).view(f"S{4 * window}") if len(self.keys) else self.keys

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the benchmark, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def keys(ids: np.ndarray, starts: np.ndarray, width: np.ndarray | int, window: int) -> np.ndarray:
    """The next ``width`` words at each start as one byte string, in the order of the words.

    A word 0 ends a key, as no benchmark word follows it. ``ids`` has ``window`` zeros at its end.
    """
    if not len(starts):
        return np.zeros(0, f"S{4 * window}")
    step = np.arange(window)
    got = ids[starts[:, None] + step]
    got[step[None, :] >= np.broadcast_to(width, len(starts))[:, None]] = 0
    got *= np.logical_and.accumulate(got > 0, axis=1)
    return np.ascontiguousarray(got.astype(">u4")).reshape(-1).view(f"S{4 * window}")


def _runs(ids: np.ndarray) -> np.ndarray:
    """How many words from each on are of the benchmark."""
    n = len(ids)
    end = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(end[::-1])[::-1] - np.arange(n)


def matches(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``ids``, window) of every occurrence of every window in a shard."""
    padded = np.concatenate([ids, np.zeros(windows.window, np.int32)])
    places = np.flatnonzero(_runs(ids) >= max(windows.shortest, 1))
    suffixes = keys(padded, places, windows.window, windows.window)
    order = np.argsort(suffixes, kind="stable")  # the suffix array
    suffixes = suffixes[order]
    low = np.searchsorted(suffixes, windows.keys, "left")
    high = np.searchsorted(suffixes, windows.upper, "right")
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return places[order[low[which] + within]], which


def _longest(place, which, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length in words, item) of each match that can't be made longer."""
    count = np.diff(windows.place_from)[which]
    pair = np.repeat(np.arange(len(which)), count)
    slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + windows.place_from[which][pair]
    p, item, diagonal = place[pair], windows.item[slot], place[pair] - windows.at[slot]
    order = np.lexsort((p, diagonal, item))
    p, item, diagonal, width = p[order], item[order], diagonal[order], windows.width[which][pair][order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    return p[first], p[last] - p[first] + width[last], item[first]


def _marker(shared, carried: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for batch in small_batches(batches, 2000):
            data, offsets = text_buffers(batch.column("text"))
            before = batch.column("marks").to_pylist()
            out = []
            for start, end in slices(offsets):
                hashes, rows, _ = word_hashes(data, offsets[start : end + 1], ALPHANUMERIC)
                out += _marked_rows(windows.ids(hashes), rows, before[start:end], windows)
            marks = pa.array(out, pa.struct([
                ("hit_from", pa.list_(pa.int32())), ("hit_to", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string()), ("n_words", pa.int64()),
            ]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), marks], names=[*carried, "marks"])

    return mark


def _marked_rows(ids: np.ndarray, rows: np.ndarray, before: list[dict | None], windows: Windows) -> list[dict]:
    n = len(rows) - 1
    # a 0 after each row: no match goes on into the next
    spread = np.insert(ids, rows[1:], 0) if n else ids
    begin = rows[:-1] + np.arange(n)
    place, which = matches(spread, windows)
    row = np.searchsorted(begin, place, "right") - 1
    at, length, item = _longest(place, which, windows)
    found = np.searchsorted(begin, at, "right") - 1
    by_row = {int(r): np.flatnonzero(row == r) for r in np.unique(row)}
    out = []
    for r in range(n):
        old = before[r] or {"hit_from": [], "hit_to": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None}
        new = old | {"n_words": int(rows[r + 1] - rows[r])}
        if r in by_row:
            own = by_row[r]
            edge = np.zeros(new["n_words"] + 1, np.int64)
            np.add.at(edge, place[own] - begin[r], 1)
            np.add.at(edge, place[own] - begin[r] + windows.width[which[own]], -1)
            np.add.at(edge, np.array(old["hit_from"], np.int64), 1)
            np.add.at(edge, np.array(old["hit_to"], np.int64), -1)
            hit = np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8))
            mine = np.flatnonzero(found == r)
            best = mine[np.lexsort((item[mine], at[mine], -length[mine]))[0]]
            new |= {"hit_from": np.flatnonzero(hit == 1).tolist(), "hit_to": np.flatnonzero(hit == -1).tolist()}
            new["items"] = sorted({*old["items"], *(windows.names[k] for k in np.unique(item[mine]))})
            if length[best] > old["longest"]:
                new |= {"longest": int(length[best]), "longest_at": int(at[best] - begin[r]), "longest_item": windows.names[item[best]]}
        out.append(new)
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    return benchmark.select(named, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _chunk(items: DataFrame, k: int, n: int) -> list[tuple[str, str]]:
    """Chunk k of n, in a fixed order: about CHUNK_BYTES, or one item that is longer."""
    part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
    return [tuple(x) for x in part.distinct().sort("item", "text").collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with a struct ``marks``: which of its words lie in windows of ``benchmark``.

    ``marks`` holds n_words, the hit words as runs from ``hit_from`` to before ``hit_to``,
    the ids of the ``items`` met (as strings, sorted), and length, place and item of the
    longest verbatim match (ties: first place, then first item). A column ``marks`` of ``docs``
    is replaced; other columns go through.

    Words are runs of 0-9, a-z and whatever isn't ASCII, A-Z as a-z. Null and blank texts have
    none. Items that repeat an id count as one item; a null id is called "null"; an item without
    words has no window. An empty benchmark marks nothing.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != "marks"]
    text = F.col("text").cast("string").alias("text")
    out = docs.select(*[text if c == "text" else F.col(c) for c in names], F.lit(None).cast(_MARKS).alias("marks"))
    schema = out.schema
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    for k in range(n):
        shared = spark.sparkContext.broadcast(Windows(_chunk(items, k, n), window))
        last = k == n - 1
        if last and keep is not None:
            schema = T.StructType([schema[c] for c in [*keep, "marks"]])
        out = out.mapInArrow(_marker(shared, schema.names[:-1]), schema)
        if not last:
            # written, so that no later job needs this chunk again, in the driver or in a task
            out = settle(out, "marked")
            shared.destroy()
    return out


def n_hit() -> Column:
    """Words of a marked document that lie in a window."""
    size = lambda c: F.aggregate(F.col(f"marks.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    return size("hit_to") - size("hit_from")


def contaminated(share: int = 20) -> Column:
    """Whether a marked document has hit words, and one in ``share`` of its words at least."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("marks.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with the same columns."""
    other = docs.withColumnRenamed("marks", "marks of docs")
    kept = contamination(other, benchmark, window).filter(~contaminated(share)).drop("marks")
    return kept.withColumnRenamed("marks of docs", "marks").select(*docs.columns)
