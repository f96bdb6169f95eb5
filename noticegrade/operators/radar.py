"""Early warning: risk of newly certified domains, bursts of alike names, watchlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.functions.skew import lookup_join
from noticegrade.functions.storage import settle

BASELINE_HOURS = 24


# ---- naming signals ---------------------------------------------------------------


def naming_signals(
    domain: Column,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
) -> Column:
    """Distinct signals of one name.

    Runs of letters before the suffix, ``t:`` tokens contained, ``s:`` suffix, and
    ``c:`` character signals (digits, hyphens).
    """
    suffix = S.public_suffix(domain, suffixes)
    cut = F.length(domain) - F.when(suffix != "", F.length(suffix) + 1).otherwise(F.lit(0))
    stem = F.substring(domain, F.lit(1), cut)
    marks = [F.when(domain.contains(t), F.lit(f"t:{t}")) for t in tokens]
    marks += [
        F.when(suffix != "", F.concat(F.lit("s:"), suffix)),
        F.when(stem.rlike("[0-9]"), F.lit("c:digit")),
        F.when(stem.contains("-"), F.lit("c:hyphen")),
    ]
    words = F.regexp_extract_all(stem, F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.array_compact(F.array(*marks))))


def known_domains(
    joined: DataFrame,
    cutoff: str,
    threshold: float = settings.ACTION_THRESHOLD,
    rate: str = "domain_removal_rate",
) -> DataFrame:
    """One row per domain seen before the cutoff; ``is_pirate`` if its mean rate reaches
    the threshold. The rest are the background."""
    return (
        joined.where((F.col("date") < F.lit(cutoff).cast("date")) & F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(F.avg(rate).alias("_mean"))
        .select("domain", (F.coalesce("_mean", F.lit(0.0)) >= threshold).alias("is_pirate"))
    )


def fit_pattern_scorer(
    known: DataFrame,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
) -> DataFrame:
    """Weight per naming signal: add-one smoothed log odds, pirate against background.

    ``known`` has one row per domain with ``is_pirate``. The result is a table, so the
    vocabulary may be as large as it likes.
    """
    counted = settle(
        known.select("is_pirate", F.explode(naming_signals(F.col("domain"), tokens, suffixes)).alias("signal"))
        .groupBy("signal")
        .agg(
            F.count_if("is_pirate").alias("pirate_domains"),
            F.count_if(~F.col("is_pirate")).alias("other_domains"),
        ),
        "signals",
    )
    sums = counted.agg(
        F.struct(
            F.sum("pirate_domains").alias("p"),
            F.sum("other_domains").alias("b"),
            F.count(F.lit(1)).alias("v"),
        )
    ).scalar()
    odds_in = (F.col("pirate_domains") + 1) / (F.col("_s.p") + F.col("_s.v"))
    odds_out = (F.col("other_domains") + 1) / (F.col("_s.b") + F.col("_s.v"))
    return counted.withColumn("_s", sums).select(
        "signal",
        "pirate_domains",
        "other_domains",
        (F.ln(odds_in) - F.ln(odds_out)).alias("weight"),
    )


def score_domains(
    domains: DataFrame,
    scorer: DataFrame,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
) -> DataFrame:
    """Add ``risk`` in [0, 1] to a table with one row per domain.

    Signals unknown to the scorer add nothing. The other columns travel with the signals'
    sum, so the domains aren't joined to themselves. The sum is rounded
    so that names with the same signals get the same risk in whatever order they add up.
    """
    rest = [c for c in domains.columns if c != "domain"]
    signals = naming_signals(F.col("domain"), tokens, suffixes)
    exploded = domains.select(*domains.columns, F.explode_outer(signals).alias("signal"))
    weighted = lookup_join(exploded, scorer.select("signal", "weight"), ["signal"])
    z = F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 9)
    scores = weighted.groupBy("domain").agg(z.alias("_z"), *(F.any_value(c).alias(c) for c in rest))
    return scores.select(*domains.columns, (1 / (1 + F.exp(-F.col("_z")))).alias("risk"))


# ---- certificate events -------------------------------------------------------------


def explode_hosts(messages: DataFrame) -> DataFrame:
    """One event per distinct host of a certificate: domain, issuer, seen_at.

    ``messages`` has the nested feed columns ``message_type`` and ``data``. Hosts are
    normalised and a leading wildcard label is removed.
    """
    host = F.transform(
        "data.leaf_cert.all_domains",
        lambda h: S.clean_domain(S.drop_wildcard(S.strip_space(h))),
    )
    return (
        messages.where(F.col("message_type") == "certificate_update")
        .select(
            F.explode(F.array_distinct(host)).alias("domain"),
            F.col("data.leaf_cert.issuer.O").alias("issuer"),
            F.timestamp_micros(F.round(F.col("data.seen") * 1e6).cast("bigint")).alias("seen_at"),
        )
        .where(F.col("domain").isNotNull())
    )


def new_domains(events: DataFrame) -> DataFrame:
    """First sighting of each domain."""
    return events.groupBy("domain").agg(
        F.min("seen_at").alias("first_seen"), F.count(F.lit(1)).alias("sightings")
    )


# ---- bursts -------------------------------------------------------------------------


def name_signature(
    domain: Column,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
) -> Column:
    """Contained tokens in sorted order, then the suffix: ``live+stream|xyz``."""
    marks = [F.when(domain.contains(t), F.lit(t)) for t in sorted(tokens)]
    return F.concat(F.concat_ws("+", *marks), F.lit("|"), S.public_suffix(domain, suffixes))


def window_counts(events: DataFrame, window_minutes: int = settings.BURST_WINDOW_MINUTES) -> DataFrame:
    """Events per tumbling window and signature. Batch and stream share it."""
    return (
        events.groupBy(
            F.window("seen_at", f"{window_minutes} minutes").alias("_w"),
            name_signature(F.col("domain")).alias("signature"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "signature", "n")
    )


def flag_bursts(
    counts: DataFrame,
    window_minutes: int = settings.BURST_WINDOW_MINUTES,
    *,
    min_count: int = 5,
    z_threshold: float = 3.0,
) -> DataFrame:
    """Compare each window with the mean of the signature's previous 24 hours.

    Windows without events count as 0 in the mean. The window function runs over counts:
    one row per window and signature, whatever the number of events.
    """
    seconds = F.unix_seconds("window_start")
    trailing = (
        Window.partitionBy("signature")
        .orderBy(seconds)
        .rangeBetween(-BASELINE_HOURS * 3600, -1)
    )
    per_day = BASELINE_HOURS * 60 / window_minutes
    expected = F.coalesce(F.sum("n").over(trailing), F.lit(0)) / F.lit(float(per_day))
    z = (F.col("n") - F.col("expected")) / F.sqrt(F.greatest("expected", F.lit(0.5)))
    return (
        counts.withColumn("expected", expected)
        .withColumn("z", z)
        .withColumn("is_burst", (F.col("n") >= min_count) & (F.col("z") >= z_threshold))
    )


def detect_bursts(
    events: DataFrame, window_minutes: int = settings.BURST_WINDOW_MINUTES, **options
) -> DataFrame:
    """Window counts of the events with their baseline, z and burst flag."""
    return flag_bursts(window_counts(events, window_minutes), window_minutes, **options)


# ---- watchlist ------------------------------------------------------------------------


def sightings(events: DataFrame) -> DataFrame:
    """One row per domain with first and last sighting."""
    return events.groupBy("domain").agg(
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.count(F.lit(1)).alias("sightings"),
    )


def rank_watchlist(scored: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` riskiest domains, ranked. Only those k rows are numbered."""
    top = scored.orderBy(F.col("risk").desc(), "domain").limit(k)
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("risk").desc(), "domain"))
    )


def watchlist(events: DataFrame, scorer: DataFrame, k: int = 100) -> DataFrame:
    return rank_watchlist(score_domains(sightings(events), scorer), k)
