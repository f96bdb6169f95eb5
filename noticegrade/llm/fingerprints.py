"""Locality-sensitive fingerprints of whole texts: a quartile digest of hashed byte triplets.

Every three neighbouring bytes of a text are hashed into one of ``BUCKETS`` buckets. The digest
says of each bucket in which quartile of the text's bucket counts it lies (two bits), and has
the text's length on a logarithmic scale and how its quartiles relate in front. Small edits
move few buckets across a quartile, so digests of like texts differ in few places.

As hex: 2 digits of length, 2 of quartile ratios, then ``BUCKETS`` / 2 of buckets. The difference
of two digests is bounded, which makes likeness a number from 0 to 1; equal texts have equal
digests and likeness 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrade.functions.storage import settle
from noticegrade.llm.words import mix, slices, text_buffers

BUCKETS = 1024
_TABLES = (mix(np.arange(768, dtype=np.uint64), 51).reshape(3, 256) % np.uint64(BUCKETS)).astype(np.uint16)
#: No text in UTF-8 holds this byte; it stands after a text's end, so short texts have triplets too.
_END = b"\xff\xff"
#: Bytes whose triplets are counted at a time.
_BLOCK = 1 << 20
#: Difference of two buckets by how far their quartiles lie apart.
_APART = np.array([0, 1, 2, 6])
_MOST = 6 * BUCKETS + 255 + 30


def _counts(text: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _BLOCK):
        x = np.frombuffer((text[at : at + _BLOCK + 2] + _END)[: min(_BLOCK, len(text) - at) + 2], np.uint8)
        n = len(x) - 2
        total += np.bincount(_TABLES[0][x[:n]] ^ _TABLES[1][x[1 : n + 1]] ^ _TABLES[2][x[2:]], minlength=BUCKETS)
    return total


class Digest:
    """A text's digest in parts: length class, quartile ratios, quartile of each bucket."""

    def __init__(self, text: str) -> None:
        data = text.encode()
        counts = _counts(data)
        low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.length = min(255, round(8 * math.log2(1 + len(data))))
        self.ratios = (int(low * 15 // high) if high else 0, int(mid * 15 // high) if high else 0)
        self.codes = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).astype(np.uint8)

    def raw(self) -> bytes:
        four = self.codes.reshape(-1, 4)
        packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
        return bytes([self.length, self.ratios[0] << 4 | self.ratios[1]]) + packed.astype(np.uint8).tobytes()

    @classmethod
    def parse(cls, fingerprint: str) -> Digest:
        out = cls.__new__(cls)
        out.length, out.ratios = int(fingerprint[:2], 16), (int(fingerprint[2], 16), int(fingerprint[3], 16))
        packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
        out.codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1)
        return out

    def difference(self, other: Digest) -> int:
        """From 0 to ``_MOST``."""
        header = abs(self.length - other.length) + sum(abs(a - b) for a, b in zip(self.ratios, other.ratios, strict=True))
        return header + int(_APART[np.abs(self.codes.astype(np.int8) - other.codes)].sum())

    def likeness(self, other: Digest) -> float:
        return 1 - self.difference(other) / _MOST


def fingerprint(text: str | None) -> str:
    return Digest(text or "").raw().hex()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    return Digest.parse(a).likeness(Digest.parse(b))


#: Hashes and digests stay bytes, half as long as their hex, until they are returned.
_RESULT = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)
_FIELDS = [part.split()[0] for part in _RESULT.split(", ")]


def _compared(text: str, digest: Digest, after: str, after_digest: Digest) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = Digest(edited)
    sha = hashlib.sha256(edited.encode()).digest()
    return len(text), sha, digest.raw(), other.raw(), digest.likeness(other), digest.likeness(after_digest)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``_BLOCK`` bytes of text."""
    for batch in batches:
        for start, end in slices(text_buffers(batch.column("text"))[1], _BLOCK):
            yield batch.slice(start, end - start)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition against the one after it.

    The first and the last row come once more with their text, as ``edge`` 0 and 1: the
    last row's result needs the next partition's first.
    """
    part = TaskContext.get().partitionId()
    held = None
    for batch in _in_parts(batches):
        rows, edges = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            digest = Digest(text)
            if held is None:
                edges.append((0, doc_id, text))
            else:
                rows.append((held[0], *_compared(held[1], held[2], text, digest)))
            held = doc_id, text, digest
        yield _batch(rows, edges, part)
    if held is not None:
        yield _batch([], [(1, held[0], held[1])], part)


_EDGED = f"doc_id long, {_RESULT}, edge int, part int, text string"


def _batch(rows: list[tuple], edges: list[tuple], part: int) -> pa.RecordBatch:
    blank = (None,) * len(_FIELDS)
    full = [(*r, None, part, None) for r in rows] + [(i, *blank, kind, part, text) for kind, i, text in edges]
    columns = list(zip(*full, strict=True)) or [()] * (len(_FIELDS) + 4)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = ["doc_id", *_FIELDS, "edge", "part", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (i, *_compared(a, Digest(a), b, Digest(b)))
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)
        ]
        yield _batch(rows, [], 0).select(["doc_id", *_FIELDS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how near it is to that and to the next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's, in the order of doc_id; the last document's next is the
    first. Null texts are empty. Null ids come first, rows that repeat an id are ordered by a
    hash of their text; a single document is its own next. Other columns aren't looked at.

    Rows are dealt to tasks by ranges of doc_id, so neighbours meet in one task, which reads
    them one after another; only each range's first and last text are matched up afterwards.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    done = settle(ordered.mapInArrow(_neighbours, _EDGED), "fingerprints")

    # ranges in a circle: by their numbers alone, then their texts
    parts = done.filter("edge = 0").select("part")
    circle = Window.orderBy("part")
    first = F.min("part").over(circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("part", F.coalesce(F.lead("part").over(circle), first).alias("next_part"))
    starts = done.filter("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    ends = done.filter("edge = 1").select("doc_id", "part", "text")
    ends = ends.join(parts, "part").join(starts, "next_part").select("doc_id", "text", "after")
    ends = ends.mapInArrow(_pairs, f"doc_id long, {_RESULT}")
    out = done.filter("edge is null").select("doc_id", *_FIELDS).unionByName(ends)
    shown = [F.lower(F.hex(c)).alias(c) if k == "binary" else F.col(c) for c, k in out.dtypes]
    return out.select(*shown)
