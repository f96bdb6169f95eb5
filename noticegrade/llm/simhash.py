"""Near-duplicate documents by SimHash, with pigeonring filtering.

A document's shingles are hashed to 64 bits (XXH64); a bit of its fingerprint is 1 if it is set
in more than half of the hashes. Documents are linked if their fingerprints differ in at most
``BITS`` bits.

Fingerprints are cut into ``2 * BITS + 1`` segments that form a ring. By the pigeonhole
principle, some segment of two linked fingerprints differs in no more than its share of the
bits. The pigeonring principle says more: from some segment on, every chain of consecutive
segments keeps within its proportional budget, so k segments together differ in no more than
floor(k * BITS / segments) bits. With 2 bits and 5 segments, two neighbouring segments are
equal, three and four differ in one bit at most. Fingerprints meet by the equal segments at the
chain's start; pairs whose longer chains go over a budget are dropped before all bits are compared.

Equal fingerprints are one node of the graph. Only components are wanted, so a group of
fingerprints that share a chain's start needs no pair for each two of them once it is large:
then each member names itself and every fingerprint one bit away, outside of the equal
segments, and members that name the same one are linked to the least of them. Members that
differ in two bits both name those between, and whoever names the same one differs in two bits
at most, so components stay exact and rows follow the members, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle
from noticegrade.llm.components import components
from noticegrade.llm.words import slices, small_batches, text_buffers

WORDS, BITS, SEED = 3, 2, 42
#: Up to so many members of a group are paired; it doesn't change results.
PAIRED = 32
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z are a-z. The words of a shorter text are one shingle."""
    found = text.lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_buffers(batch.column("text"))
            prints: list[int] = []
            for low, high in slices(offsets):
                raw, limits = data[offsets[low] : offsets[high]].tobytes(), (offsets[low : high + 1] - offsets[low]).tolist()
                prints += [simhash(shingle_hashes(raw[a:b], words)) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], names=["doc_id", "fingerprint"])

    return sign


def _mask(low: int, high: int) -> int:
    """Bits from ``low`` to before ``high``, as a signed number."""
    value = (1 << high) - (1 << low)
    return value - (1 << 64) if value >= 1 << 63 else value


def _segments() -> list[int]:
    """A mask for each segment of the ring."""
    n = 2 * BITS + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [_mask(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _chain(masks: list[int], start: int, length: int) -> int:
    out = 0
    for k in range(length):
        out |= masks[(start + k) % len(masks)]
    return out


def _budget(length: int) -> int:
    return length * BITS // (2 * BITS + 1)


def _starts(prints: DataFrame) -> DataFrame:
    """(group, start, fingerprint): a row for each segment at which a chain may start.

    A group's name is a hash of the start and the segments that must be equal there.
    """
    masks = _segments()
    equal = next(k for k in range(len(masks), 0, -1) if _budget(k) == 0)
    entries = [
        F.struct(F.lit(i).alias("start"), F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_chain(masks, i, equal)))).alias("group"))
        for i in range(len(masks))
    ]
    return prints.select("fingerprint", F.explode(F.array(*entries)).alias("x")).select("x.group", "x.start", "fingerprint")


def _within(differing: Column, start: Column) -> Column:
    """Whether every chain from ``start`` keeps within its budget."""
    masks = _segments()
    out = F.lit(False)
    for i in range(len(masks)):
        chains = F.lit(True)
        for k in range(1, len(masks) + 1):
            chains = chains & (F.bit_count(differing.bitwiseAND(F.lit(_chain(masks, i, k)))) <= _budget(k))
        out = out | ((start == i) & chains)
    return out


def _paired(members: DataFrame) -> DataFrame:
    """Links among the members of each group, two by two."""
    a = members.select("group", "start", F.col("fingerprint").alias("a"))
    b = members.select("group", F.col("fingerprint").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    met = a.join(b, "group").filter(F.col("a") < F.col("b"))
    return met.filter(_within(differing, F.col("start"))).filter(F.bit_count(differing) <= BITS).select("a", "b")


def _named(members: DataFrame) -> DataFrame:
    """Links of each member to the least that names the same fingerprint."""
    masks = _segments()
    equal = next(k for k in range(len(masks), 0, -1) if _budget(k) == 0)
    free = [[k for k in range(64) if not _chain(masks, i, equal) >> k & 1] for i in range(len(masks))]
    flips = [F.array(*(F.lit(_mask(k, k + 1)) for k in places)) for places in free]
    chosen = F.element_at(F.array(*flips), F.col("start") + 1)
    around = F.concat(F.array(F.lit(0).cast("long")), chosen)
    named = members.select("group", "fingerprint", F.explode(around).alias("flip"))
    named = settle(named.select("group", "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("named")), "named")
    least = named.groupBy("group", "named").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("last")).filter("a < last")
    links = named.join(least.drop("last"), ["group", "named"]).filter(F.col("a") < F.col("fingerprint"))
    links = links.select("a", F.col("fingerprint").alias("b"))
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).distinct()


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): links among distinct fingerprints that have the components of all that differ in ``BITS`` bits."""
    members = settle(_starts(prints), "starts")
    sizes = members.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    met = settle(members.join(sizes, "group"), "groups")
    small, large = met.filter(F.col("members") <= paired), met.filter(F.col("members") > paired)
    return _paired(small).unionByName(_named(large)).distinct()


def simhash_duplicates(docs: DataFrame, words: int = WORDS, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    ``fingerprint`` is a signed 64-bit number, ``component_id`` the smallest doc_id reachable over
    fingerprints that differ in at most ``BITS`` bits. Words stand between white space of
    ASCII; a shingle is ``words`` of them joined by a space, a text with fewer is one shingle.

    Null, empty and blank texts have no shingle and fingerprint 0, and are linked like any other.
    A null doc_id counts for links and is nobody's component; its own component is null if no
    document it reaches has an id. Rows that repeat, or repeat a doc_id, stay rows of their own.
    Other columns aren't looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(texts.mapInArrow(_signer(words), "doc_id long, fingerprint long"), "signed")
    classes = settle(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(classes.select("fingerprint"), paired)).withColumnRenamed("node", "fingerprint")
    placed = classes.join(joined, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fingerprint", "component").join(smallest, "component").select("fingerprint", "component_id")
    return signed.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
