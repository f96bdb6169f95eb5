"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``; labels and benchmark items are
read from the tables beside it. ``run`` applies the stages in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle
from noticegrade.llm.decontaminate import decontaminate
from noticegrade.llm.lines import dedup_lines
from noticegrade.llm.near_dedup import near_duplicates
from noticegrade.llm.pieces import tokenise
from noticegrade.llm.quality import classify_quality

#: Words of a shingle, and percent of resemblance from which documents are near duplicates.
SHINGLE_WORDS, RESEMBLANCE = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; every row is judged by its own text, null and empty ones too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_quality(docs, labels).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in an earlier place, short ones included; ``n_chars`` follows."""
    out = dedup_lines(docs, least_chars=20, least_exact=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of smallest doc_id.

    Rows that share an id, or have none, are told apart by their text: they are no link between
    others, come after all ids that stand once, in the order of a hash, and of those that repeat
    id and text one stays. Other texts without words stay.
    """
    ids = docs.groupBy(F.col("doc_id").alias("id ")).agg(F.count("*").alias("rows "))
    odd = settle(ids.filter("`rows ` > 1 or `id ` is null").select("id "), "ids")
    shared = F.col("doc_id").eqNullSafe(F.col("id "))
    own = docs.join(odd, shared, "left_anti").withColumn("row ", F.col("doc_id").cast("long"))
    late = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    told = docs.join(odd, shared, "left_semi").withColumn("row ", late).dropDuplicates(["row "])
    rows = own.unionByName(told)
    linked = near_duplicates(rows.select(F.col("row ").alias("doc_id"), "text"), SHINGLE_WORDS, RESEMBLANCE)
    gone = linked.filter("not kept").select(F.col("doc_id").alias("row "))
    return rows.join(gone, "row ", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages. Rows without words and repeated rows stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document, with the check that decoding gives the text."""
    return tokenise(docs, keep=["doc_id"], add=["ids", "n_tokens", "round_trip"])


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
