"""Takedown-shaped views of the TPC-H-like test tables (see FIXTURES.md).

They stand in for the real request and domain tables so that every operator can be
run over whole tables and checked against SQL on the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.functions.storage import settle

CUTOFF = "2000-09-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, options: dict, default: str) -> Column:
    out = F.lit(default)
    for value, text in options.items():
        out = F.when(key == value, F.lit(text)).otherwise(out)
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (request, domain) rows with one of the four buckets filled."""
    part = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    infix = _choose(kind, {0: "-live", 1: "-stream", 2: "hd", 3: "-news", 4: "-blog"}, "")
    tld = _choose(
        F.col("p_type"),
        {"ECONOMY": "xyz", "LARGE": "com", "MEDIUM": "ru", "PROMO": "co.uk", "SMALL": "net"},
        "stream",
    )
    named = part.select(
        "p_partkey",
        F.concat(
            F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
            infix,
            F.col("p_size").cast("string"),
            F.lit("."),
            tld,
        ).alias("domain"),
        (kind < 3).alias("pirate"),
    )
    qty = F.col("l_quantity").cast("int")
    flag, status, pirate = F.col("l_returnflag"), F.col("l_linestatus"), F.col("pirate")

    def bucket(cond: Column, name: str) -> Column:
        return F.when(cond, qty).otherwise(F.lit(0)).alias(name)

    return (
        table(spark, sf_dir, "lineitem")
        .join(named, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("request_id"),
            "domain",
            bucket((flag == "A") | ((flag == "N") & pirate), "urls_removed"),
            bucket((flag == "R") & (status == "F"), "urls_not_in_index"),
            bucket((flag == "N") & ~pirate, "urls_no_action"),
            bucket((flag == "R") & (status == "O"), "urls_pending"),
        )
    )


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).cast("int").alias(c) for c in settings.URL_COUNTS))


def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four outcome buckets per (request, domain).

    The lines are dealt by request alone: few of them share a domain too, so sums before the
    move would not shorten it, and what is later summed by request is summed where it lies.
    """
    return _summed(_lines(spark, sf_dir).repartition("request_id"), "request_id", "domain")


def _with_outcomes(df: DataFrame) -> DataFrame:
    return df.withColumn("urls_specified", S.urls_specified()).withColumn(
        "removal_rate", S.removal_rate(F.col("urls_removed"), F.col("urls_specified"))
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean domain table."""
    return _with_outcomes(domain_counts(spark, sf_dir)).withColumn("from_abuser", F.lit(False))


def request_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("date")
    )


def requests(
    spark: SparkSession, sf_dir: str, counts: DataFrame | None = None
) -> DataFrame:
    """Clean request table; requests without domains have nothing specified.

    ``counts`` may be a written domain table to sum up.
    """
    sums = _summed(_lines(spark, sf_dir) if counts is None else counts, "request_id")
    owners = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    context = (
        table(spark, sf_dir, "orders")
        .join(owners, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("c_nationkey").cast("bigint").alias("reporting_org_id"),
            F.col("n_name").alias("reporting_org"),
            F.col("o_custkey").alias("copyright_owner_id"),
            F.col("c_name").alias("copyright_owner"),
            (F.col("o_orderstatus") == "P").alias("from_abuser"),
            F.concat(F.lit("https://notices.example/"), F.col("o_orderkey").cast("string")).alias(
                "lumen_url"
            ),
        )
    )
    counted = context.join(sums, "request_id", "left").select(
        *context.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in settings.URL_COUNTS)
    )
    return _with_outcomes(counted)


def written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(domains, requests) as written Parquet tables, the way the feature jobs find them."""
    d = settle(domains(spark, sf_dir), "domains")
    return d, settle(requests(spark, sf_dir, d), "requests")


def raw_requests(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Request table as dirty text under the source headers. ``counts``: see ``requests``."""
    rid = F.col("request_id")

    def when(n: int, then: Column | str, other: Column, rest: int = 0) -> Column:
        return F.when(rid % n == rest, then).otherwise(other)

    def count(name: str) -> Column:
        text = F.col(name).cast("string")
        thousands = F.concat(F.lit("1,"), F.lpad(text, 3, "0"))
        return when(97, F.lit("n/a"), when(7, thousands, text))

    owner = F.col("copyright_owner")
    padded = F.concat(F.lit("  "), F.replace(owner, F.lit("#"), F.lit("  #")), F.lit(" "))
    columns = {
        "request_id": rid.cast("string"),
        "date": when(
            101,
            F.lit("bad"),
            F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00Z")),
        ),
        "lumen_url": F.col("lumen_url"),
        "copyright_owner_id": when(211, F.lit(None), F.col("copyright_owner_id").cast("string")),
        "copyright_owner": when(
            53, F.lit("  "), when(5, F.upper(owner), when(5, padded, owner, rest=1))
        ),
        "reporting_org_id": F.col("reporting_org_id").cast("string"),
        "reporting_org": F.col("reporting_org"),
        "urls_removed": count("urls_removed"),
        "urls_not_in_index": count("urls_not_in_index"),
        "urls_no_action": when(89, F.lit("-5"), count("urls_no_action")),
        "urls_pending": count("urls_pending"),
        "from_abuser": F.when(rid % 4 == 0, "true")
        .when(rid % 4 == 1, " TRUE ")
        .when(rid % 4 == 2, "false"),
    }
    return requests(spark, sf_dir, counts).select(
        *(columns[name].alias(source) for source, name in settings.REQUEST_COLUMNS.items())
    )


def raw_domains(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Domain table as dirty text under the source headers. ``counts`` may be the written ``domain_counts``."""
    rid, domain = F.col("request_id"), F.col("domain")
    name = F.concat(
        F.when(rid % 9 == 0, F.lit("\t")).otherwise(F.lit("")),
        F.when(rid % 3 == 0, F.upper(domain)).otherwise(domain),
        F.when(rid % 4 == 0, F.lit(".")).otherwise(F.lit("")),
    )
    columns = {c: F.col(c).cast("string") for c in settings.URL_COUNTS}
    columns |= {
        "request_id": rid.cast("string"),
        "domain": F.when(rid % 997 == 0, F.lit(" ")).otherwise(name),
        "from_abuser": F.when(rid % 10 == 0, "True").otherwise("false"),
    }
    return (domain_counts(spark, sf_dir) if counts is None else counts).select(
        *(columns[name].alias(source) for source, name in settings.DOMAIN_COLUMNS.items())
    )


def dirty_requests(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """The raw requests without every 31st, whose domains then have no request."""
    rid = F.col(f"`{next(s for s, c in settings.REQUEST_COLUMNS.items() if c == 'request_id')}`")
    return raw_requests(spark, sf_dir, counts).where(rid.cast("bigint") % 31 != 0)


def dirty_domains(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """The raw domains, some of them twice in spellings that cleaning makes one."""
    raw = raw_domains(spark, sf_dir, counts)
    names = {c: s for s, c in settings.DOMAIN_COLUMNS.items()}
    again = raw.where(F.col(f"`{names['request_id']}`").cast("bigint") % 61 == 0)
    spelt = F.concat(F.lit(" "), F.upper(F.col(f"`{names['domain']}`")), F.lit(".."))
    return raw.unionByName(again.withColumn(names["domain"], spelt))


def owner_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("copyright_owner_id"),
        (1 + F.col("c_custkey") % 3).cast("double").alias("weight"),
    )


def certificate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate feed messages as JSON text, one per event.

    Each certificate names a host and its wildcard. Every 40th event falls into one
    quarter of an hour on the 20th and shares one kind of name: a spike to detect.
    """
    user, spike = F.col("user_id"), F.col("event_id") % 40 == 0
    kind = _choose(
        F.col("event_type"),
        {"view": "live-stream", "click": "watch-hd", "purchase": "shop", "signup": "portal"},
        "status",
    )
    suffix = _choose(user % 5, {0: "xyz", 1: "ru", 2: "com", 3: "net"}, "co.uk")
    host = F.when(
        spike, F.concat(F.lit("match-live-"), user.cast("string"), F.lit(".xyz"))
    ).otherwise(F.concat(kind, F.lit("-"), user.cast("string"), F.lit("."), suffix))
    shown = F.when(F.col("event_id") % 3 == 0, F.upper(host)).otherwise(host)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    in_spike = F.lit(1_705_777_200_000_000) + F.pmod(micros, F.lit(900_000_000))
    seen = F.when(spike, in_spike).otherwise(micros)
    message = F.struct(
        F.lit("certificate_update").alias("message_type"),
        F.struct(
            F.struct(
                F.array(shown, F.concat(F.lit("*."), host)).alias("all_domains"),
                F.struct(F.concat(F.lit("CA-"), (user % 7).cast("string")).alias("O")).alias(
                    "issuer"
                ),
            ).alias("leaf_cert"),
            (seen.cast("double") / 1e6).alias("seen"),
        ).alias("data"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", seen.alias("seen_micros"), F.to_json(message).alias("value")
    )


def takedown_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate messages that name the domains of takedown requests, as JSON text.

    Event n is a certificate for all domains of request n, seen up to half a month before or
    after the request's date.
    """
    named = domain_counts(spark, sf_dir).groupBy("request_id").agg(F.sort_array(F.collect_set("domain")).alias("hosts"))
    epoch = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    shift = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), shift.alias("shift"))
    both = events.join(named, "request_id").join(request_dates(spark, sf_dir), "request_id")
    seen = F.unix_date("date").cast("long") * 86_400_000_000 + F.col("shift")
    leaf = F.struct(F.col("hosts").alias("all_domains"), F.struct(F.lit("CA").alias("O")).alias("issuer"))
    data = F.struct(leaf.alias("leaf_cert"), (seen.cast("double") / 1e6).alias("seen"))
    message = F.struct(F.lit("certificate_update").alias("message_type"), data.alias("data"))
    return both.select(F.to_json(message).alias("value"))


def broken_lines(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Raw text with line breaks, quotes and commas put into one column of every seventh row."""
    text = F.concat(F.coalesce(F.col(f"`{column}`"), F.lit("")), F.lit('\n"cited", line\n'))
    return raw.withColumn(column, F.when(F.col(f"`{key}`").cast("bigint") % 7 == 0, text).otherwise(F.col(f"`{column}`")))


def csv_folder(raw: DataFrame, folder: str) -> str:
    """Raw text written as CSV files with headers, quoted where needed."""
    writer = raw.write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
    writer.option("ignoreTrailingWhiteSpace", "false").csv(folder)
    return folder


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", S.clean_domain(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)).alias("domain")
    )
