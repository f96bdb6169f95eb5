"""Line dedup over a whole corpus, by a join on deletion neighbourhoods.

Two lines are alike if one edit at most (a character put in, left out or replaced) makes one
of the other. A line goes if an alike line stands earlier: in a document of smaller id, or
further up in its own. Empty lines stay. Where ``least_chars`` is set higher than one, lines below
it go only if they equal an earlier line and have ``least_exact`` characters or more.

A line's neighbourhood is all its variants with one character left out, as hashes. Variants
are joined by grouping: with the place of the missing character in the key, all lines of a
group are alike (they differ in that place alone); without it, the lines that lack a character
meet the line that equals the variant. The least line of a group is all that's needed, so no
pairs are made.

A variant for each character of each line would be hundreds of times the text. An edit leaves a
line's first or its last part as it is, so at first each line has two hashes, of a part at its
start and one at its end, and only lines that share one with another line go on. These are cut
in blocks; lines that agree outside of one block make variants for the characters of that block
only. Neither step can lose an alike line. Texts go through one shuffle, to be put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle

LEAST_CHARS = 1
#: Blocks that a line is cut into before variants are made.
BLOCKS = 8
#: A table of hashes with up to so many rows is broadcast (16 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 1 << 20

_PLACE = ["doc_id", "text_hash", "at"]
_LINE = ["h1", "h2"]


def _end(line: Column, n: Column) -> Column:
    """The last ``n`` characters."""
    return F.when(n > 0, F.substring(line, -n, n)).otherwise("")


def _lines(docs: DataFrame, least_chars: int, least_exact: int) -> DataFrame:
    """Every line of ``least_exact`` or more: its place, hashes, and hashes of its two ends.

    Lines below ``least_chars`` have no ends, so no other line is like them but by equality.
    The ends' length is the largest power of two that is no more than half the line, none for a
    single character. A line
    whose length is a power of two has ends of half that length too, for lines one shorter.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    rows = rows.withColumn("n", F.length("line")).filter(F.col("n") >= min(least_exact, least_chars))
    line = F.col("line")
    rows = rows.withColumn("part", F.expr("IF(n > 1, shiftleft(1, length(bin(n)) - 2), 0)"))
    part, twice = F.col("part"), (F.col("n") == 2 * F.col("part")) & (F.col("n") > 1)
    half = (part / 2).cast("int")
    long = F.col("n") >= least_chars
    return rows.select(
        *_PLACE, "line", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"),
        F.when(long, F.xxhash64(F.lit(0), part, F.substring(line, F.lit(1), part))).alias("e0"),
        F.when(long, F.xxhash64(F.lit(1), part, _end(line, part))).alias("e1"),
        F.when(long & twice, F.xxhash64(F.lit(0), half, F.substring(line, F.lit(1), half))).alias("e2"),
        F.when(long & twice, F.xxhash64(F.lit(1), half, _end(line, half))).alias("e3"),
    )


def _bounded(keys: DataFrame) -> DataFrame:
    """A written table of hashes, marked for broadcast if its counted rows allow."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def _candidates(lines: DataFrame, first: DataFrame) -> DataFrame:
    """First occurrences, with their text, of lines that share an end with another line."""
    ends = ["e0", "e1", "e2", "e3"]
    every = first.select("h1", F.explode(F.array_compact(F.array(*ends))).alias("end"))
    shared = every.groupBy("end").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y")
    shared = settle(shared.select("end"), "ends")
    # a line once for each of its ends, from its first occurrence alone
    places = first.select(*_LINE, "first.*", F.explode(F.array_compact(F.array(*ends))).alias("end"))
    wanted = settle(places.join(_bounded(shared), "end", "left_semi").select(*_PLACE).distinct(), "wanted")
    key = F.xxhash64(*_PLACE)
    keyed = wanted.select(key.alias("key"), *(F.col(c).alias(f"w_{c}") for c in _PLACE))
    match = [F.col("key") == F.col("own"), *(F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in _PLACE)]
    found = lines.select(*_PLACE, *_LINE, "line", key.alias("own")).join(_bounded(keyed), match, "left_semi")
    return settle(found.select(*_PLACE, *_LINE, "line"), "candidates")


def _variants(candidates: DataFrame, blocks: int) -> DataFrame:
    """Variants of each line in those blocks outside of which it agrees with another line.

    For lines of ``size`` characters, and for lines of one more, block b leaves the first
    b * width and the last size - (b + 1) * width characters. ``full`` marks a block as it is.
    """
    place = F.struct(*_PLACE).alias("place")
    n = F.length("line")
    rows = candidates.select(place, *_LINE, "line", F.explode(F.array(n, n - 1)).alias("size"))
    width = F.ceil(F.col("size") / blocks).cast("int")
    rows = rows.withColumn("width", width).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    before, after = F.col("b") * F.col("width"), F.col("size") - (F.col("b") + 1) * F.col("width")
    rows = rows.filter(before < F.col("size")).withColumn("before", before).withColumn("after", F.greatest(after, F.lit(0)))
    start, end = F.substring(F.col("line"), F.lit(1), F.col("before")), _end(F.col("line"), F.col("after"))
    both = [F.xxhash64(F.lit(k), "size", "b", start, F.lit("|"), end).alias(f"g{k}") for k in (1, 2)]
    middle = F.substring(F.col("line"), F.col("before") + 1, F.length("line") - F.col("before") - F.col("after"))
    cut = rows.select("place", *_LINE, *both, middle.alias("middle"))
    groups = cut.groupBy("g1", "g2").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("g1", "g2")
    cut = cut.join(groups, ["g1", "g2"], "left_semi")

    m = F.col("middle")
    without = lambda i: F.concat(F.substring(m, F.lit(1), i), F.substring(m, i + 2, F.length(m)))
    entry = lambda at, full, variant: F.struct(at.alias("at"), F.lit(full).alias("full"), variant.alias("variant"))
    every = F.when(F.length(m) > 0, F.sequence(F.lit(0), F.length(m) - 1)).otherwise(F.array().cast("array<int>"))
    placed = F.transform(every, lambda i: entry(i, False, without(i)))
    unplaced = F.transform(every, lambda i: entry(F.lit(-1), False, without(i)))
    whole = F.array(entry(F.lit(-1), True, m))
    out = cut.select("place", "g1", "g2", F.explode(F.concat(placed, unplaced, whole)).alias("x"))
    hashes = [F.xxhash64(F.lit(k), "g1", "g2", "x.variant", "x.at").alias(f"v{k}") for k in (1, 2)]
    return out.select("place", *hashes, "x.full", (F.col("x.at") >= 0).alias("by_place"))


def _alike(candidates: DataFrame, blocks: int) -> DataFrame:
    """Places of lines that have an alike earlier line, which is checked to be so."""
    variants = settle(_variants(candidates, blocks), "variants")
    key = ["v1", "v2", "by_place"]
    earliest = lambda which: F.min(F.when(which, F.col("place")))
    groups = variants.groupBy(*key).agg(
        F.count("*").alias("members"), earliest(F.col("full")).alias("whole"), earliest(~F.col("full")).alias("lacking")
    )
    met = variants.join(groups.filter("members > 1"), key)
    other = F.when(F.col("by_place") | F.col("full"), F.col("lacking")).otherwise(F.col("whole"))
    pairs = met.select("place", other.alias("other")).filter(F.col("other") < F.col("place"))
    links = pairs.groupBy("place").agg(F.min("other").alias("other"))
    # the check: edit distance of both texts
    text = candidates.select(F.struct(*_PLACE).alias("place"), "line")
    both = links.join(text, "place").join(text.select(F.col("place").alias("other"), F.col("line").alias("earlier")), "other")
    return both.filter(F.levenshtein("line", "earlier", 1) >= 0).select("place.*")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, blocks: int = BLOCKS, least_exact: int | None = None) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and n_lines, n_exact and n_near.

    A line (what stands between line feeds) of ``least_chars`` or more characters goes if an
    alike line stands earlier; n_exact counts those that equal an earlier line, n_near the
    others that are one edit away from one. Of shorter lines, those of ``least_exact`` or more
    (None: no shorter ones) go if they equal an earlier line. Other and empty lines stay. A text
    whose lines all go is empty, its row stays; a null text stays null and has no lines.

    Earlier is a smaller doc_id (null is smallest), then a smaller place in the text. Rows that
    repeat a doc_id are ordered by a hash of their text; rows that repeat both are one document
    and keep the same lines. Columns of ``docs`` with an added name are replaced.
    """
    added = ("n_lines", "n_exact", "n_near")
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    lines = _lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least_chars, least_chars if least_exact is None else max(least_exact, 1))
    place = F.struct(*_PLACE)
    first = lines.groupBy(*_LINE, "e0", "e1", "e2", "e3").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    first = settle(first, "lines")

    repeated = lines.select(*_PLACE, *_LINE).join(first.filter("times > 1").select(*_LINE, "first"), _LINE)
    exact = repeated.filter(F.col("first") < place).select(*_PLACE, F.lit(False).alias("near"))
    near = _alike(_candidates(lines, first), blocks).withColumn("near", F.lit(True))
    gone = exact.unionByName(near).groupBy(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash"))
    gone = gone.agg(*(F.collect_set(F.when(F.col("near") == near, F.col("at"))).alias(f"gone {c}") for c, near in (("exact", False), ("near", True))))

    same = F.xxhash64("text").eqNullSafe(F.col("gone hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gone id"))
    out = docs.join(gone, same, "left")
    places = F.concat("gone exact", "gone near")
    out = out.withColumn("gone parts", F.when(F.col("gone hash").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("gone parts") - 1), places), lambda i: F.element_at("gone parts", i + 1))
    text = F.when(F.col("gone parts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    number = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0).cast("long"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.coalesce((breaks + 1).cast("long"), F.lit(0).cast("long"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in names]
    return out.select(*columns, n_lines.alias("n_lines"), number("gone exact").alias("n_exact"), number("gone near").alias("n_near"))
