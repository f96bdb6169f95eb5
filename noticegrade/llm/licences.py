"""Licence mentions in whole texts, by ordered signature rules.

A text without any rule's anchor word is let go after one scan. In the others, every word that
is a rule's keyword is met with that keyword's rules, and each rule's expression is matched on
the words that follow. Detections that overlap are resolved by priority and containment: one
that lies within another of the same or a better priority is suppressed (of equal intervals,
the better priority stays, then the earlier rule). Everything is done by the engine's own
expressions; the table of rules has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrade.functions.storage import settle
from noticegrade.llm.licence_rules import BASE, CONFIDENCE, LONGEST, NAMED, NOTICE, TAG, VERSIONED, gate, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_ROW = ["doc_id", "uid"]


def rule_rows() -> list[tuple[str, int, int, str, str, float]]:
    """(label, priority, rank, keyword, pattern, confidence); the base phrases have priority 0."""
    base = [(label, 0, k, phrase.split(" ")[0], phrase, 0.0) for k, (phrase, label) in enumerate(BASE.items())]
    return base + [(r.label, r.priority, k, r.keyword, r.pattern, CONFIDENCE[r.priority]) for k, r in enumerate(rules())]


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAP, " ")), " ")


def _scanned(docs: DataFrame) -> DataFrame:
    """Per row its number of words and the keywords it has, each with its place and what follows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keywords = sorted({row[3] for row in rule_rows()})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text")).withColumn("n_words", F.regexp_count("text", F.lit(_WORD)).cast("long"))
    rows = rows.withColumn("words", F.when(F.col("text").rlike(gate()), _words(F.col("text"))))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())
    rows = rows.select(*_ROW, "n_words", "words", at.alias("places"))
    after = F.transform(
        "places", lambda i: F.struct(i.cast("long").alias("start"), F.element_at("words", i + 1).alias("keyword"), F.concat(F.array_join(F.slice("words", i + 1, LONGEST), " "), F.lit(" ")).alias("after"))
    )
    return rows.select(*_ROW, "n_words", after.alias("found"))


def detections(found: DataFrame) -> DataFrame:
    """(doc_id, uid, start, end, label, priority, confidence) of each match, suppressed ones left out.

    ``found`` has a row for each keyword in a text: doc_id, uid, start, keyword, after. Base
    phrases come along with priority 0 and are neither suppressed nor suppress others.
    """
    table = found.sparkSession.createDataFrame(rule_rows(), "label string, priority int, rank int, keyword string, pattern string, confidence double")
    met = found.join(F.broadcast(table), "keyword")  # some hundred rules
    match = F.expr("regexp_extract(after, concat('^(?:', pattern, ') '), 0)")
    met = met.withColumn("match", match).filter("match <> ''")
    length = F.length("match") - F.length(F.replace("match", F.lit(" "), F.lit("")))
    met = met.select(*_ROW, "start", (F.col("start") + length).alias("end"), "label", "priority", "rank", "confidence")
    order = Window.partitionBy(*_ROW).orderBy("start", F.desc("end"), "priority", "rank").rowsBetween(Window.unboundedPreceding, -1)
    kinds = (TAG, VERSIONED, NAMED, NOTICE)
    reach = {k: F.max(F.when(F.col("priority") == k, F.col("end"))).over(order) for k in kinds}
    inside = F.lit(False)
    for k in kinds:
        inside = inside | ((F.col("priority") >= k) & F.coalesce(F.col(f"reach{k}") >= F.col("end"), F.lit(False)))
    met = met.withColumns({f"reach{k}": c for k, c in reach.items()})
    return met.filter((F.col("priority") == 0) | ~inside).select(*_ROW, "start", "end", "label", "priority", "confidence")


def _joined(labels: Column) -> Column:
    return F.coalesce(F.array_join(F.sort_array(labels), ","), F.lit(""))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    Words are runs of 0-9, a-z and what isn't ASCII, A-Z as a-z. n_base counts the places of the
    base phrases, first_word and last_word are the smallest and the largest of them (null if
    none). ``labels`` are those of base phrases and of detections that aren't suppressed, distinct,
    sorted, comma-joined. ``score`` is the confidence of the surest detection, 0 without one.
    Null and empty texts have no words. Rows that repeat give the same result each; other columns
    aren't looked at.
    """
    scanned = settle(_scanned(docs), "licences")
    found = scanned.filter("size(found) > 0").dropDuplicates(_ROW).select(*_ROW, F.explode("found").alias("f")).select(*_ROW, "f.*")
    base = lambda c: F.when(F.col("priority") == 0, F.col(c))
    per_row = detections(found).groupBy(*_ROW).agg(
        F.count(base("start")).alias("n_base"),
        F.min(base("start")).alias("first_word"),
        F.max(base("start")).alias("last_word"),
        F.collect_set(base("label")).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("confidence").alias("score"),
    )
    per_row = per_row.withColumnRenamed("doc_id", "d")
    same = (scanned["uid"] == per_row["uid"]) & scanned["doc_id"].eqNullSafe(per_row["d"])
    return scanned.join(per_row, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        _joined(F.col("base_labels")).alias("base_labels"),
        _joined(F.col("labels")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
