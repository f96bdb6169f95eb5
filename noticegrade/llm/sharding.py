"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A partial partition is a list of ``shards`` sums. Differencing takes the two partial partitions
with the largest spread (largest less smallest sum) and adds them in opposite order, largest
sums to smallest, until one is left.

A task can't hold all groups of a large input, and every group takes part all the same. Groups
that hold a set part of all bytes or rows are differenced first (there can't be many). The others
go by hash to buckets of bounded size, a task each: a bucket differences its groups together with
its share of the heavy groups' sums, so it fills up what those leave uneven. The first
bucket comes after the others and takes their sums instead of a share, so it levels what
is left of all.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrade.functions.storage import settle

SHARDS = 40
#: A group of more than 1 / (shards * HEAVY) of all bytes or rows is placed with others of its kind.
HEAVY = 64
#: Other groups that one task differences, about.
BUCKET_GROUPS = 8192
#: Rows of a shard that one task numbers.
CELL_ROWS = 20_000
ROW_BYTES = 16


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where[i, j]: the final place of sum j of part i; the final sums), for sums (n, shards).

    The larger spread is taken first; among equal spreads, the part that came earlier.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = [row for row in np.take_along_axis(parts, order, axis=1)]
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []  # the parts of node n + i; its place j was place [j] of the sum
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        at = np.argsort(-total, kind="stable")
        total = total[at]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums)))
        sums.append(total)
        merged.append((a, b, at))
    # from the last node down: where each node's sorted places end
    places = [None] * len(sums)
    places[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, at = merged[node - n]
        before = np.empty(k, np.int64)
        before[at] = places[node]
        places[a], places[b], places[node] = before, before[::-1], None
    where = np.empty((n, k), np.int64)
    np.put_along_axis(where, order, np.stack(places[:n]), axis=1)
    return where, sums[-1]


def fill(sizes: np.ndarray, begun: list[int], turn: int = 0) -> np.ndarray:
    """The shard of each of ``sizes``, when the shards hold ``begun`` already.

    ``turn`` moves equal sums on, so that many calls don't favour the same shards.
    """
    shards = len(begun)
    parts = np.zeros((len(sizes) + 1, shards), np.int64)
    parts[0] = np.roll(np.array(begun, np.int64), turn)
    parts[1:, 0] = sizes
    where = difference(parts)[0]
    shard_at = np.empty(shards, np.int64)
    shard_at[where[0]] = (np.arange(shards) - turn) % shards
    return shard_at[where[1:, 0]]


def _placed(groups: DataFrame, within: str, begun: list[int], whole: int) -> DataFrame:
    """(key, size, shard) of ``groups``; each value of ``within`` is one task, with its share (size of ``whole``) of ``begun``."""

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key"], ascending=[False, True])
        share = int(frame["size"].sum())
        own = [x * share // whole for x in begun] if whole else begun
        shard_of = fill(frame["size"].to_numpy(), own, int(frame[within].iloc[0]))
        return pd.DataFrame({"key": frame["key"], "size": frame["size"], "shard": shard_of})

    return groups.select("key", "size", within).groupBy(within).applyInPandas(place, "key binary, size long, shard int")


def _sums(placed: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["size"] for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def balance(groups: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Where ``groups`` (key, size, rows) go: (key, shard) of the heavy groups, and of the others.

    Keys are unique, sizes longs of 0 or more. There are fewer than 2 * shards * HEAVY heavy groups.
    The driver sees totals and a sum per shard.
    """
    total = groups.agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).first()
    large = lambda c: F.col(c).cast("decimal(38,0)") * (shards * HEAVY) > F.lit(total[c] or 0)
    groups = groups.withColumn("heavy", large("size") | large("rows"))
    one = groups.filter("heavy").withColumn("bucket", F.lit(0))
    heavy = settle(_placed(one, "bucket", [0] * shards, 0), "heavy")
    begun = _sums(heavy, shards)
    light = groups.filter("not heavy")
    count, whole = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(count / BUCKET_GROUPS))
    light = light.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    if buckets == 1:
        return heavy.select("key", "shard"), settle(_placed(light, "bucket", begun, 0), "light").select("key", "shard")
    most = settle(_placed(light.filter("bucket > 0"), "bucket", begun, whole), "light")
    begun = [x + y for x, y in zip(begun, _sums(most, shards), strict=True)]
    last = settle(_placed(light.filter("bucket = 0"), "bucket", begun, 0), "last")
    return heavy.select("key", "shard"), most.unionByName(last).select("key", "shard")


def numbered(rows: DataFrame, within: str, by: list[str], count: int) -> DataFrame:
    """``rows`` with a gapless ``slot`` from 0 within each value of ``within``.

    ``count`` is the number of rows. Rows go by hash of ``by`` to cells of about ``CELL_ROWS``;
    sums of the cells' counts give where each cell's numbers begin.
    """
    cells = max(1, math.ceil(count / (CELL_ROWS * SHARDS)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*by), F.lit(cells)))
    begin = F.sum("n").over(Window.partitionBy(within).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(within, "cell").agg(F.count("*").alias("n"))
    counts = counts.select(within, "cell", F.coalesce(begin, F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy(within, "cell").orderBy(*by)).cast("long") - 1
    return rows.withColumn("own", own).join(counts, [within, "cell"]).withColumn("slot", F.col("own") + F.col("begin")).drop("cell", "own", "begin")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, the law is ``bytes``: shards of
    near-equal total size, where rows with equal texts (null equal to empty) stay together.
    One group larger than a shard's part makes that shard larger; the others stay near equal.
    ``slot`` numbers a shard's rows from 0 without gaps. Repeated rows and null ids are rows
    like others; ``grown_shard`` is null under this law. Other columns aren't looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = settle(rows, "sized")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    heavy, light = balance(settle(groups, "groups"), shards)
    # rows of heavy groups travel through no join; the others' keys have few rows each
    heavy = F.broadcast(heavy)
    placed = rows.join(heavy, "key").unionByName(rows.join(heavy, "key", "left_anti").join(light, "key"))
    out = numbered(placed, "shard", ["doc_id", "key"], rows.count())
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
