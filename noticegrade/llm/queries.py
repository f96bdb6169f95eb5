"""The registered queries: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade.functions.storage import fresh_folder
from noticegrade.llm.decontaminate import contaminated, contamination, n_hit
from noticegrade.llm.extract import extract
from noticegrade.llm.fingerprints import fingerprints
from noticegrade.llm.licences import scan_licences
from noticegrade.llm.lines import dedup_lines
from noticegrade.llm.near_dedup import near_duplicates
from noticegrade.llm.periodic import periodic_runs
from noticegrade.llm.pieces import tokenise
from noticegrade.llm.quality import classify_quality, held_out
from noticegrade.llm.sharding import shard
from noticegrade.llm.simhash import simhash_duplicates
from noticegrade.llm.spelling import spelling_variants, vocabulary
from noticegrade.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = classify_quality(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_exact", "n_near")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokenise(docs, keep=["doc_id"], add=["n_tokens", "ids_sha256", "round_trip", "parity"], parity_every=1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "boilerplate", "repeated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("marks.items")
    return marked.select(
        "doc_id",
        F.col("marks.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    found = read_archives(spark, folder).filter("gap is null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents made periodic from some word on, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    w = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    found = found.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("n", F.size("w"))
    first = (F.col("g") % F.col("n")).cast("int")
    found = found.withColumn("first", F.when(F.col("n") > 0, first))
    period = 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.col("g") % 8)).cast("int")
    found = found.withColumn("period", period)
    place = lambda i: F.when(i < F.col("first"), i).otherwise(F.col("first") + (i - F.col("first")) % F.col("period"))
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i)))
    return found.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(_table(spark, sf_dir, "documents")), keep=["doc_id"])
    # the first of the runs with the greatest length / period, as they are in order of start and period
    longer = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(longer(a, x), x).otherwise(a))
    line = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(_table(spark, sf_dir, "documents"), damage_every=199)
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_fingerprints": op4_fingerprints,
    "op5_extract": op5_extract,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_licences": op10_licences,
    "op11_periods": op11_periods,
    "op12_spelling": op12_spelling,
    "op13_simhash": op13_simhash,
}
