"""Connected components of a graph given as links, by alternating stars.

Each round points every node at the smallest node it knows of, first for its larger
neighbours, then for its smaller ones. Links stay at most as many as they were; a hub's links
are met in a join whose large partitions adaptive execution splits. Every round is written to
the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle

FILE_LINKS = 50_000


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.filter("b < a")
    low = near.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    move = both.filter("b > a") if larger else near
    moved = move.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = low.select("a", F.col("low").alias("b"))
    out = moved if larger else moved.unionByName(own)
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _written(links: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """``links`` written, and what tells whether they are still the same, from the same pass.

    With ``most`` links known beforehand they go to as few files as hold ``FILE_LINKS`` each.
    """
    seen = Observation()
    if most is not None:
        links = links.coalesce(max(1, math.ceil(most / FILE_LINKS)))
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    out = settle(links.observe(seen, *mark), "links")
    return out, tuple(seen.get.values())


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links`` (a, b) and the smallest node it reaches.

    Self-links and nulls are left out; a graph without links gives an empty table.
    """
    now = links.select("a", "b").filter("a <> b")
    now, mark = _written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        now, after = _written(_star(_star(now, larger=True), larger=False), mark[0])
        if after == mark:
            break
        mark = after
    pointed = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pointed.unionByName(roots)
