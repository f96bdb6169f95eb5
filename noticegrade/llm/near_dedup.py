"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two values of the signature, the smallest and
the largest image, so ``permutations`` evaluations a shingle make a signature twice as long.
Both ends agree between two sets with probability J (their resemblance) each. Bands of
``rows`` permutations (2 x rows values) key the buckets in which candidates meet.

With the production values (96 permutations, bands of 3, so 32 bands of 6 values) two
documents of resemblance exactly 0.8 share no band with probability 6e-5, of 0.85 with 3e-7.

Links are confirmed on full sets of shingles. Documents with equal sets are one class first.
A bucket's members are held against its smallest member, which makes at most a pair for each.
What is left after the components of those links are members of different components of one bucket. In buckets of a bounded
size they are paired in full; in larger ones those are paired that share one of their rarest
shingles, of which each document has so many that a link can't be missed (prefix filtering). So
a large group of like documents doesn't make pairs with the square of its size, and no link
that could change a component is left out. Those sets meet by shingle, block of sizes and
component, after the bounds have taken out what can have no partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle
from noticegrade.llm.components import components
from noticegrade.llm.words import SPACE_SEPARATED, mix, slices, small_batches, text_buffers, word_hashes

PERMUTATIONS = 96
ROWS = 3
#: Up to so many members a bucket's open pairs are taken in full; beyond, by shared rare shingles.
PAIRED = 64
#: Shingles of up to so many of those documents come first in the order; it doesn't change results.
RARE = 64
#: Shingles are permuted in blocks of so many, so a very long text needs no more memory.
_BLOCK = 4096


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle; without words, none.
    """
    data, offsets = text_buffers(column)
    weights = mix(np.arange(words, dtype=np.uint64), 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        for start, end in slices(offsets):
            hashes, rows, _ = word_hashes(data, offsets[start : end + 1], SPACE_SEPARATED)
            n = len(hashes)
            total = np.zeros(max(n - words + 1, 0), np.uint64)
            for k in range(words):
                total += hashes[k : n - words + 1 + k] * weights[k] if n >= words else 0
            total = mix(total, 1)
            for low, high in zip(rows[:-1], rows[1:], strict=True):
                if high - low >= words:
                    yield np.unique(total[low : high - words + 1])
                elif high > low:
                    whole = (hashes[low:high] * weights[: high - low]).sum(dtype=np.uint64)
                    yield mix(np.array([whole + np.uint64(high - low)], np.uint64), 2)
                else:
                    yield np.zeros(0, np.uint64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    flip = mix(np.arange(n, dtype=np.uint64), 21)
    times = mix(np.arange(n, dtype=np.uint64), 22) | np.uint64(1)
    return flip[:, None], times[:, None]


def min_max_signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """permutations x (smallest, largest image) of a non-empty set."""
    flip, times = _permutations(permutations)
    low = np.full(permutations, np.uint64(2**64 - 1))
    high = np.zeros(permutations, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _BLOCK):
            image = (shingles[None, at : at + _BLOCK] ^ flip) * times
            np.minimum(low, image.min(axis=1), out=low)
            np.maximum(high, image.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def _bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` permutations; the rest that fills no band is left out."""
    count = len(signature) // rows
    parts = signature[: count * rows].reshape(count, 2 * rows)
    key = mix(np.arange(count, dtype=np.uint64), 31)
    for k in range(2 * rows):
        key = mix(key ^ parts[:, k], 32 + k)
    return key


def _signer(words: int, permutations: int, rows: int):
    fields = ["doc_id", "n_shingles", "set_a", "set_b", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, set_a, set_b, bands, limits = [], [], [], [], [0]
            for shingles in shingle_sets(batch.column("text"), words):
                sizes.append(len(shingles))
                set_a.append(mix(shingles, 41).sum(dtype=np.uint64))
                set_b.append(mix(shingles, 42).sum(dtype=np.uint64))
                if len(shingles):
                    bands.append(_bands(min_max_signature(shingles, permutations), rows))
                limits.append(limits[-1] + (len(bands[-1]) if len(shingles) else 0))
            keys = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(keys, pa.int64()))
            of = [np.array(x, np.uint64).view(np.int64) for x in (set_a, set_b)]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *map(pa.array, of), lists]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return sign


def _set_reader(words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = list(shingle_sets(batch.column("text"), words))
            limits = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "shingles"])

    return read


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct shingle of a batch of sets, the number of its sets, and their keys."""
    for batch in batches:
        sets = batch.column("shingles")
        values = sets.flatten().to_numpy(zero_copy_only=False)
        keys = np.repeat(batch.column("key").to_numpy(), sets.value_lengths().to_numpy())
        order = np.argsort(values, kind="stable")
        values, keys = values[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        limits = np.append(first, len(values))
        lists = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(keys))
        yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(np.diff(limits)), lists], names=["shingle", "n", "keys"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have a resemblance of ``percent`` at least."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), shared.alias("shared"))
    return both.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _undecided(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their components."""
    placed = members.select("band", "key", "n").join(found.withColumnRenamed("node", "key"), "key", "left")
    placed = settle(placed.select("band", "key", "n", F.coalesce("component", "key").alias("component")), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return placed.join(mixed.select("band"), "band", "left_semi")


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair that can still join two components: all of a small bucket's, and by prefixes."""
    large = open_.groupBy("band").agg(F.count("*").alias("size")).filter(F.col("size") > PAIRED)
    small = open_.join(large, "band", "left_anti")
    among = open_.join(large, "band", "left_semi").select("key", "n", "component").distinct()
    return _paired(small, percent).unionByName(_met(_prefixes(among, sets, percent), percent)).distinct()


def _paired(small: DataFrame, percent: int) -> DataFrame:
    one, two = (small.select("band", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "component"))) for k in "ab")
    possible = (F.col("key_a") < F.col("key_b")) & (F.col("component_a") != F.col("component_b"))
    possible = possible & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return one.join(two, "band").filter(possible).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _meetings(first: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by prefixes, on (shingle, block, other): the shorter and the longer set of a pair.

    A link's sets share percent / (100 + percent) of their summed size at least, and no more than
    what follows the first shared shingle in either's order. So that one stands in the first ninth
    of the shorter set (at 80 percent), which keeps most of a prefix out of one side. Sets meet
    only where their sizes are in one block or in neighbouring ones, and a longer set is held
    against a component only (``other``) that it isn't in, where the bounds leave it a partner.
    """
    width = math.log(100 / percent) + 0.01  # a little more than a link's sizes may be apart
    placed = first.withColumn("block", F.floor(F.log("n") / width))
    shorter = placed.filter((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"))
    heads = shorter.groupBy("shingle", "block", F.col("component").alias("other"))
    heads = heads.agg(F.min("n").alias("least_n"), F.min("own").alias("least_own"))
    longer = placed.withColumn("block", F.explode(F.array(F.col("block") - 1, "block"))).join(heads, ["shingle", "block"])
    room = (100 + percent) * (F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("least_n"))
    room = room & (100 * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least_own")))
    longer = longer.filter(room & (F.col("component") != F.col("other")) & (F.col("least_n") <= F.col("n")))
    return shorter.withColumn("other", F.col("component")), longer.drop("least_n", "least_own")


def _met(first: DataFrame, percent: int) -> DataFrame:
    on = ["shingle", "block", "other"]
    names = {"key": "", "n": "n_", "own": "own_", "at": "at_", "before": "before_"}
    one, two = (
        rows.select(*on, *(F.col(c).alias(x + k) for c, x in names.items())) for rows, k in zip(_meetings(first, percent), "ab", strict=True)
    )
    # what only one of both has can't be shared: bounds of intersection and union
    most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    least = F.greatest(F.col("n_a") + F.col("own_b"), F.col("n_b") + F.col("own_a"))
    # nor can more be shared than what follows the first shared shingle in either's order
    after = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    possible = (100 * most >= percent * least) & ((100 + percent) * after >= percent * (F.col("n_a") + F.col("n_b")))
    possible = possible & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    # a pair that shares the key before this one as well has met there
    possible = possible & F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    met = one.join(two, on).filter(possible & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefixes(among: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rarest shingles of each document, so many that linked documents must share one of them.

    With n shingles in one order for all (those of up to RARE documents by their number, then the
    others), a link needs at least percent * n / 100 shared ones, so one of the first
    n - ceil(percent * n / 100) + 1. A shingle whose documents are all of one component is left
    out. ``own`` counts a document's shingles that no other has; with too many of those it can't
    be linked at all. An id that repeats with several sets has a row for each.
    """
    held = settle(among.join(sets, "key").filter(F.size("shingles") == F.col("n")), "held")
    # a shingle once for each task, with its documents there: common ones are summed up early
    holders = settle(held.select("key", "shingles").mapInArrow(_holders, "shingle long, n long, keys array<long>"), "holders")
    often = holders.groupBy("shingle").agg(F.sum("n").alias("often")).filter(F.col("often") <= RARE)
    rare = holders.join(often, "shingle").select("shingle", "often", F.explode("keys").alias("key")).groupBy("key")
    rare = rare.agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("rare"))
    ranked = held.join(rare, "key", "left")
    rarest = F.coalesce("rare", F.array().cast("array<struct<often:long,shingle:long>>"))
    single = F.filter(rarest, lambda x: x["often"] == 1)
    # of an id's rare shingles those of this set
    ranked = ranked.withColumn("own", F.size(F.array_intersect(single["shingle"], "shingles")))
    ranked = ranked.withColumn("rare", F.array_intersect(rarest["shingle"], F.col("shingles")))
    linkable = ranked.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = linkable.withColumn("ranked", F.concat("rare", F.array_except("shingles", "rare")))
    rows = rows.withColumn("shingle", F.slice("ranked", F.lit(1), length.cast("int")))
    rows = rows.withColumn("before", F.concat(F.array(F.lit(None).cast("long")), "shingle"))
    rows = rows.select("key", "n", "component", "own", F.posexplode(F.arrays_zip("shingle", "before")).alias("at", "x"))
    first = settle(rows.select("key", "n", "component", "own", "at", "x.shingle", "x.before").filter("shingle is not null"), "prefixes")
    mixed = first.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return first.join(mixed.select("shingle"), "shingle", "left_semi")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    A shingle is ``words`` consecutive words between white space, A-Z as a-z. Documents are
    linked if 100 * |A and B| >= percent * |A or B|; ``component_id`` is the smallest doc_id
    reachable over links, ``kept`` marks the document that has it.

    Null or blank texts have no shingle and no link. A null doc_id is counted, is linked with
    nothing and has a null component and kept = true, as nothing says that it's a copy. Rows
    that repeat a doc_id are one document for links (any of the texts may link it). Other
    columns aren't looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    signed = settle(texts.mapInArrow(_signer(words, permutations, rows), kinds), "signed")

    # equal sets are one class, known by its smallest document
    full = signed.filter("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("key"))
    classes = settle(classes, "classes")
    of_class = ["set_a", "set_b", "n_shingles"]
    same = full.select("doc_id", *of_class).join(classes.select("key", *of_class), of_class)
    same = same.select(F.col("doc_id").alias("a"), F.col("key").alias("b"))

    # a bucket's members against its smallest member
    members = classes.select("key", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    members = settle(members.join(buckets.select("band", "low"), "band"), "members")
    stars = members.filter("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()

    # full sets of the documents that have a candidate
    needed = members.select("key").distinct()
    reader = texts.withColumnRenamed("doc_id", "key").join(needed, "key")
    sets = settle(reader.mapInArrow(_set_reader(words), "key long, shingles array<long>"), "sets")
    links = _confirmed(stars, sets, percent).unionByName(same.filter("a <> b"))

    # a bucket's members may link to others than its smallest: every pair that could still join
    # two components of a bucket
    found = components(links)
    pairs = _across(_undecided(members, found), sets, percent).join(stars, ["a", "b"], "left_anti")
    pointers = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = pointers.unionByName(_confirmed(pairs, sets, percent))

    final = components(links).withColumnRenamed("node", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
