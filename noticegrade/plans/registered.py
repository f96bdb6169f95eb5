"""Each operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Results are shaped for comparison with SQL: doubles rounded, dates and flags as plain
text and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.functions.storage import fresh_folder, settle
from noticegrade.operators import backtest, clean, evaluate, explain, features, history
from noticegrade.operators import joined as J
from noticegrade.operators import models, profile, radar, select, trees
from noticegrade.plans import ingest, model_frame, scoring, views
from noticegrade.sources import certificates, raw, split_csv, tables
from noticegrade.sources import views as V
from noticegrade.streaming import radar as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LEAD_CUTOFF = "1995-04-01"
SAMPLE_ROWS = 5000
# a fixed linear explanation, so that reasons can be checked without training
EXPLAINED = {
    # feature: (median, mean, scale, coefficient)
    "request_urls_log1p": (4.5, 4.4, 0.9, 0.35),
    "request_not_in_index_ratio": (0.2, 0.24, 0.2, -0.7),
    "request_no_action_ratio": (0.2, 0.25, 0.22, -0.8),
    "request_dow": (3.0, 3.0, 2.0, 0.05),
    "request_month": (6.0, 6.4, 3.4, -0.02),
    "request_org_historical_hit_rate": (0.5, 0.48, 0.03, 0.9),
    "request_owner_historical_hit_rate": (0.5, 0.49, 0.1, 0.45),
    "domain_has_suspicious_token": (0.0, 0.5, 0.5, 0.75),
    "suspicious_token_count": (0.0, 0.55, 0.62, 1.3),
    "tld_is_risky": (0.0, 0.45, 0.5, 0.6),
    "domain_length": (14.0, 15.2, 3.1, -0.4),
    "digit_ratio": (0.1, 0.11, 0.04, 0.2),
    "hyphen_count": (1.0, 1.4, 0.6, 0.3),
    "domain_historical_hit_rate": (0.5, 0.47, 0.2, 1.1),
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, dates to text, flags to 0/1."""
    shown = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "date":
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        elif kind == "timestamp":
            c = F.unix_micros(c)
        shown.append(c.alias(f.name))
    return df.select(*shown)


#: Columns of the model frame that models, candidates and screens read.
WANTED = ["request_id", "domain", "date", "copyright_owner_id", "domain_removal_rate", *settings.FEATURES, "action"]


def _domains(spark: SparkSession, sf: str) -> DataFrame:
    """The clean domain table as it is written, with equal names side by side, which packs well."""
    return settle(V.domains(spark, sf).sortWithinPartitions(F.xxhash64("domain")), "domains")


def _frame(spark: SparkSession, sf: str, domains: DataFrame | None = None) -> DataFrame:
    """The frame of the written domains; the requests are read once, so they aren't written before."""
    domains = _domains(spark, sf) if domains is None else domains
    return model_frame.model_frame(domains, V.requests(spark, sf, domains), columns=WANTED)


def _scored(spark: SparkSession, sf: str, domains: DataFrame | None = None) -> DataFrame:
    return _frame(spark, sf, domains).withColumn("score", model_frame.plain_score())


def _candidates(spark: SparkSession, sf: str, domains: DataFrame | None = None) -> DataFrame:
    return model_frame.candidates(_scored(spark, sf, domains), V.owner_weights(spark, sf), V.CUTOFF)


def _written_candidates(spark: SparkSession, sf: str, domains: DataFrame | None = None) -> DataFrame:
    """The scored-output table that ranking, selection and the screens read."""
    return settle(
        _candidates(spark, sf, domains).select(
            "request_id", "domain", "date", "step_start", "score", "weight", "cost_minutes",
            "action", "domain_removal_rate", *EXPLAINED,
        ),
        "scored",
    )


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return J.join_domains(V.domains(spark, sf), V.requests(spark, sf))


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """The few columns of the joined table that domain histories and the scorer need."""
    grain = V.domains(spark, sf).select(
        "request_id", "domain", F.col("removal_rate").alias("domain_removal_rate")
    )
    return J.attach_context(grain, V.request_dates(spark, sf))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return radar.explode_hosts(certificates.parse_messages(V.certificate_messages(spark, sf)))


def _scorer(spark: SparkSession, sf: str) -> DataFrame:
    return radar.fit_pattern_scorer(radar.known_domains(_dated(spark, sf), V.CUTOFF))


# ---- cleaning ---------------------------------------------------------------------


@query
def contract_rename(spark, sf):
    return clean.apply_contract(V.raw_requests(spark, sf), settings.REQUEST_COLUMNS)


def _from_csv(spark, df, key, column, columns):
    """The raw table written as CSV with line breaks in a column, and read again by ranges."""
    folder = V.csv_folder(V.broken_lines(df, key, column), fresh_folder(spark, "csv"))
    return clean.apply_contract(split_csv.read_split_csv(spark, folder), columns)


@query
def scan_requests_csv(spark, sf):
    return _from_csv(spark, V.raw_requests(spark, sf), "Request ID", "Lumen URL", settings.REQUEST_COLUMNS)


@query
def scan_domains_csv(spark, sf):
    return _from_csv(spark, V.raw_domains(spark, sf), "Request ID", "Domain", settings.DOMAIN_COLUMNS)


@query
def coerce_counts(spark, sf):
    typed = clean.typed_requests(V.raw_requests(spark, sf))
    return typed.select("request_id", *settings.URL_COUNTS)


@query
def normalise_names(spark, sf):
    df = clean.apply_contract(V.raw_requests(spark, sf), settings.REQUEST_COLUMNS)
    return df.select(
        S.parse_id(F.col("request_id")).alias("request_id"),
        S.clean_name(F.col("copyright_owner")).alias("copyright_owner"),
    )


@query
def name_key_variants(spark, sf):
    df = clean.apply_contract(V.raw_requests(spark, sf), settings.REQUEST_COLUMNS)
    name = F.col("copyright_owner")
    return (
        df.groupBy(S.name_key(name).alias("name_key"))
        .agg(
            F.count_distinct(S.clean_name(name)).alias("spellings"),
            F.count(F.lit(1)).alias("requests"),
        )
        .where(F.col("name_key").isNotNull())
    )


@query
def normalise_domains(spark, sf):
    df = clean.apply_contract(V.raw_domains(spark, sf), settings.DOMAIN_COLUMNS)
    return df.select(
        S.parse_id(F.col("request_id")).alias("request_id"),
        S.clean_domain(F.col("domain")).alias("domain"),
    )


@query
def bool_parse(spark, sf):
    flag = S.parse_flag(F.col("from_abuser"))
    df = clean.apply_contract(V.raw_requests(spark, sf), settings.REQUEST_COLUMNS)
    return df.select(
        "request_id",
        F.when(flag, "yes").when(~flag, "no").otherwise("unknown").alias("from_abuser"),
    )


@query
def parse_dates(spark, sf):
    typed = clean.typed_requests(V.raw_requests(spark, sf))
    return typed.select(
        "request_id",
        F.col("date").cast("string").alias("date"),
        F.coalesce("copyright_owner_id", F.lit(-1)).alias("copyright_owner_id"),
        "reporting_org_id",
    )


@query
def removal_rate(spark, sf):
    typed = clean.typed_requests(V.raw_requests(spark, sf))
    return _plain(typed.select("request_id", "urls_specified", "removal_rate"))


@query
def canonical_names(spark, sf):
    cleaned = clean.clean_requests(V.raw_requests(spark, sf))
    return cleaned.select("request_id", "copyright_owner", "reporting_org")


@query
def clean_requests(spark, sf):
    return _plain(
        clean.clean_requests(V.raw_requests(spark, sf))
        .withColumn("copyright_owner_id", F.coalesce("copyright_owner_id", F.lit(-1)))
        .withColumn("from_abuser", F.coalesce(F.col("from_abuser").cast("int"), F.lit(-1)))
    )


@query
def clean_domains(spark, sf):
    return _plain(clean.clean_domains(V.raw_domains(spark, sf)))


@query
def contract_audit(spark, sf):
    return clean.contract_audit(clean.typed_requests(V.raw_requests(spark, sf)))


@query
def row_count_audit(spark, sf):
    counts = ingest.clean_and_count(
        V.raw_requests(spark, sf),
        V.raw_domains(spark, sf),
        lambda df, name: df.write.format("noop").mode("overwrite").save(),
    )
    return ingest.audit_frame(spark, counts)


@query
def source_audit(spark, sf):
    """Write both raw tables as CSV files, audit them, and count what is read back."""
    folder = fresh_folder(spark, "raw")
    V.raw_requests(spark, sf).write.option("header", "true").option("escape", '"').option(
        "compression", "gzip"
    ).csv(f"{folder}/requests.csv.gz")
    V.raw_domains(spark, sf).write.option("header", "true").option("escape", '"').csv(
        f"{folder}/domains.csv"
    )
    audit = raw.audit_sources(spark, folder)
    counted = None
    for row in audit.collect():
        n = raw.read_raw_csv(spark, row["path"]).agg(
            F.lit(row["source"]).alias("source"), F.count(F.lit(1)).alias("rows")
        )
        counted = n if counted is None else counted.unionByName(n)
    return audit.join(counted, "source").select(
        "source",
        F.col("present").cast("int").alias("present"),
        F.col("recognised").cast("int").alias("recognised"),
        F.size("missing").alias("missing"),
        "rows",
    )


# ---- joined table and samples -------------------------------------------------------


@query
def joined(spark, sf):
    return _plain(J.check_joined_schema(_joined(spark, sf)))


@query
def joined_by_month(spark, sf):
    """Write the joined table by month and read it back."""
    path = tables.write_by_month(_joined(spark, sf), fresh_folder(spark, "joined"))
    months = tables.read_table(spark, path)
    return months.groupBy(F.col("year_month").cast("string").alias("year_month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("domain_urls_removed").alias("removed")
    )


@query
def sample_requests(spark, sf):
    return J.sample_requests(V.requests(spark, sf), SAMPLE_ROWS).select("request_id")


@query
def sample_semi(spark, sf):
    requests = V.requests(spark, sf)
    sampled = J.sample_requests(requests, SAMPLE_ROWS)
    out = J.sample_joined(V.domains(spark, sf), requests, sampled)
    return _plain(
        out.select("request_id", "domain", "date", "reporting_org", "domain_removal_rate",
                   "request_removal_rate")
    )


# ---- profile ----------------------------------------------------------------------------


@query
def top_orgs(spark, sf):
    return _plain(profile.top_names(V.requests(spark, sf), "reporting_org"))


@query
def top_owners(spark, sf):
    return _plain(profile.top_names(V.requests(spark, sf), "copyright_owner"))


@query
def monthly_volume(spark, sf):
    return _plain(profile.monthly_volume(V.requests(spark, sf)))


@query
def noise_summary(spark, sf):
    return _plain(profile.noise_summary(V.requests(spark, sf)))


@query
def org_noise(spark, sf):
    return _plain(profile.org_noise(V.requests(spark, sf), min_requests=50))


@query
def tld_noise(spark, sf):
    return _plain(profile.tld_noise(V.domains(spark, sf)))


@query
def token_summary(spark, sf):
    return _plain(profile.token_summary(V.domains(spark, sf)))


@query
def token_box(spark, sf):
    return _plain(profile.token_box(V.domains(spark, sf)))


@query
def rate_histogram(spark, sf):
    return _plain(profile.rate_histogram(V.requests(spark, sf)))


@query
def dataset_summary(spark, sf):
    return _plain(profile.dataset_summary(V.requests(spark, sf), V.domains(spark, sf)))


# ---- features and label -------------------------------------------------------------------


@query
def request_features(spark, sf):
    out = features.add_request_features(V.requests(spark, sf))
    return _plain(
        out.select("request_id", "urls_log1p", "not_in_index_ratio", "no_action_ratio", "dow",
                   "month", "org_historical_hit_rate", "owner_historical_hit_rate")
    )


def _hit_rate(df: DataFrame, group: str, rate: str, key: list[str]) -> DataFrame:
    return _plain(
        history.add_prior_rate(df, group, rate, "hit_rate").select(*key, "hit_rate")
    )


@query
def hit_rate_org(spark, sf):
    return _hit_rate(V.requests(spark, sf), "reporting_org_id", "removal_rate", ["request_id"])


@query
def hit_rate_owner(spark, sf):
    return _hit_rate(V.requests(spark, sf), "copyright_owner_id", "removal_rate", ["request_id"])


@query
def hit_rate_domain(spark, sf):
    return _hit_rate(_dated(spark, sf), "domain", "domain_removal_rate", ["request_id", "domain"])


@query
def domain_features(spark, sf):
    out = features.add_domain_features(_dated(spark, sf), input_prefix="domain_")
    return _plain(out.drop("date", "domain_removal_rate"))


@query
def domain_suffix(spark, sf):
    name = F.col("domain")
    return _plain(
        V.page_hosts(spark, sf).select(
            "page_id",
            "domain",
            S.public_suffix(name).alias("suffix"),
            S.last_label(name).alias("last_label"),
            S.digit_ratio(name).alias("digit_ratio"),
            S.hyphen_count(name).alias("hyphen_count"),
        )
    )


@query
def domain_suffix_rules(spark, sf):
    """Names under rules with a wildcard, and under their exceptions."""
    label = F.concat(F.lit("n"), F.substring_index("domain", ".", 1))
    kinds = ["a.%.ck", "%.www.ck", "%.co.uk", "city.kawasaki.jp", "b.%.kawasaki.jp", "%", "ck"]
    name = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        name = F.when(F.col("page_id") % len(kinds) == i, F.replace(F.lit(kind), F.lit("%"), label)).otherwise(name)
    hosts = V.page_hosts(spark, sf).select("page_id", name.alias("name"))
    return hosts.select("page_id", "name", S.public_suffix(F.col("name")).alias("suffix"))


@query
def domain_history(spark, sf):
    dated = _dated(spark, sf).select("request_id", "domain", "date")
    return _plain(history.add_prior_appearances(dated).drop("date"))


@query
def joined_features(spark, sf):
    """Features at domain grain through the prefixes, from the joined table."""
    frame = model_frame.model_frame_from_joined(settle(_joined(spark, sf), "joined"))
    return _plain(frame.select("request_id", "domain", "tld", *settings.FEATURES))


@query
def feature_matrix(spark, sf):
    """The same features by the cheaper route, with the label."""
    return _plain(model_frame.feature_matrix(_frame(spark, sf)))


@query
def label(spark, sf):
    out = features.make_label(V.domains(spark, sf))
    return out.select("request_id", "domain", "action")


@query
def temporal_split(spark, sf):
    train, holdout = features.temporal_split(_dated(spark, sf), V.CUTOFF)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("split"),
            F.count(F.lit(1)).alias("rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )

    return _plain(part(train, "train").unionByName(part(holdout, "holdout")))


@query
def class_balance(spark, sf):
    labelled = features.make_label(_dated(spark, sf), target_col="domain_removal_rate")
    return _plain(features.class_balance(labelled, V.CUTOFF))


@query
def impute_medians(spark, sf):
    train, _ = features.temporal_split(_frame(spark, sf), V.CUTOFF)
    return _plain(models.impute_medians(train, settings.FEATURES))


# ---- the same from dirty tables: bad days, null owners, blank, repeated and orphan domains ----


def _cleaned(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Clean domains and requests of the written counts, equal names side by side.

    They aren't written themselves: cleaning a domain moves no row, and of the requests only the
    columns that are read are then moved. Write the requests where they are read more than once.
    """
    counts = settle(V.domain_counts(spark, sf).sortWithinPartitions(F.xxhash64("domain")), "counts")
    return clean.clean_domains(V.dirty_domains(spark, sf, counts)), clean.clean_requests(V.dirty_requests(spark, sf, counts))


@query
def joined_dirty(spark, sf):
    return _plain(J.check_joined_schema(J.join_domains(*_cleaned(spark, sf))))


@query
def hit_rate_org_dirty(spark, sf):
    return _hit_rate(settle(_cleaned(spark, sf)[1], "requests"), "reporting_org_id", "removal_rate", ["request_id"])


@query
def hit_rate_owner_dirty(spark, sf):
    return _hit_rate(settle(_cleaned(spark, sf)[1], "requests"), "copyright_owner_id", "removal_rate", ["request_id"])


@query
def feature_matrix_dirty(spark, sf):
    return _plain(model_frame.feature_matrix(model_frame.model_frame(*_cleaned(spark, sf), columns=WANTED)))


@query
def replay_dirty(spark, sf):
    """Repeated and blank candidates are one each, so the ranking has no repeated key."""
    frame = model_frame.model_frame(*_cleaned(spark, sf), columns=WANTED).withColumn("score", model_frame.plain_score())
    held = model_frame.candidates(frame, V.owner_weights(spark, sf), V.CUTOFF)
    held = settle(held.select("request_id", "domain", "date", "score", "action", "domain_removal_rate"), "held")
    return _plain(backtest.replay(held).select("request_id", "domain", "step_start", "score", "rank"))


# ---- evaluation -------------------------------------------------------------------------


def _graded(spark, sf):
    """Score and outcome of the holdout, as a scoring job would leave them."""
    held = features.temporal_split(_scored(spark, sf), V.CUTOFF)[1]
    return settle(held.select("score", "action"), "graded")


@query
def pr_curve(spark, sf):
    return _plain(evaluate.pr_curve(_graded(spark, sf)))


@query
def roc_auc(spark, sf):
    return _plain(evaluate.roc_auc(_graded(spark, sf)))


@query
def average_precision(spark, sf):
    return _plain(evaluate.average_precision(_graded(spark, sf)))


@query
def calibration_curve(spark, sf):
    return _plain(evaluate.calibration_curve(_graded(spark, sf)))


def _explained(i: int) -> dict[str, float]:
    return {f: values[i] for f, values in EXPLAINED.items()}


def _contributions() -> dict[str, Column]:
    return explain.linear_contributions(list(EXPLAINED), *(_explained(i) for i in range(4)))


@query
def explain_top3(spark, sf):
    out = explain.with_top_features(_candidates(spark, sf), _contributions())
    return _plain(explain.flatten_reasons(out, ["request_id", "domain"]))


@query
def explain_tree_top3(spark, sf):
    """Reasons as the trees give them: imputed value times a fixed importance."""
    importances = {f: abs(c) / 10 for f, c in _explained(3).items()}
    parts = explain.importance_contributions(list(EXPLAINED), _explained(0), importances)
    out = explain.with_top_features(_candidates(spark, sf), parts)
    return _plain(explain.flatten_reasons(out, ["request_id", "domain"]))


@query
def predict_fixed(spark, sf):
    """Probability by two calibrated members whose weights are given, not learnt."""
    names = list(EXPLAINED)
    prep = models.Preparation(_explained(0), _explained(1), _explained(2))
    fit = models.LinearFit(prep, _explained(3), -0.25)
    model = models.TriageModel(names, models.LINEAR, [(fit, (0.9, 0.1)), (fit, (1.2, -0.3))], fit, True)
    return _plain(
        model.predict_proba(_candidates(spark, sf)).select("request_id", "domain", "action_probability")
    )


# tree, node, feature, threshold, left, right, value, weight
TREES = [
    (0, 0, "domain_historical_hit_rate", 0.48, 1, 2, 0.0, 1.0), (0, 1, None, None, None, None, -0.4, 1.0),
    (0, 2, "suspicious_token_count", 0.5, 3, 4, 0.0, 1.0), (0, 3, None, None, None, None, 0.2, 1.0),
    (0, 4, None, None, None, None, 0.9, 1.0),
    (1, 0, "request_no_action_ratio", 0.25, 1, 2, 0.0, 0.05), (1, 1, "request_month", 6.0, 3, 4, 0.0, 0.05),
    (1, 2, None, None, None, None, -1.5, 0.05), (1, 3, None, None, None, None, 0.7, 0.05),
    (1, 4, None, None, None, None, 1.1, 0.05),
    (2, 0, None, None, None, None, 0.3, 0.05),
]


@query
def tree_predict_fixed(spark, sf):
    """Margin and probability by boosted trees that are given as a table of nodes, not learnt."""
    prep = models.Preparation(_explained(0))
    nodes = spark.createDataFrame(TREES, trees.NODES)
    scored = trees.add_margin(_candidates(spark, sf), nodes, {f: prep.imputed(f) for f in EXPLAINED}, 2)
    scored = scored.withColumn("action_probability", trees.margin_probability())
    return _plain(scored.select("request_id", "domain", "margin", "action_probability"))


@query
def scale_stats(spark, sf):
    """Mean and population deviation of each feature of the training rows, once imputed."""
    train, _ = features.temporal_split(_frame(spark, sf), V.CUTOFF)
    rows = settle(train.select(*settings.FEATURES, F.lit(0).alias("_fold")), "scaled")
    (prep,) = models.learn_preparations(rows, settings.FEATURES, [rows.count()], scale=True)
    found = [(f, prep.medians[f], prep.means[f], prep.scales[f]) for f in settings.FEATURES]
    return _plain(spark.createDataFrame(found, "feature string, median double, mean double, scale double"))


FITTED = ["domain_historical_hit_rate", "suspicious_token_count"]


@query
def baseline_fit(spark, sf):
    """Coefficients of the class-weighted, penalised regression on two prepared features."""
    train, _ = features.temporal_split(_frame(spark, sf), V.CUTOFF)
    rows = settle(train.select(*FITTED, "action", F.lit(0).alias("_fold")), "train")
    counts = models.class_counts(rows, "action")
    (prep,) = models.learn_preparations(rows, FITTED, [sum(counts.values())], scale=True)
    fit = models.LinearFit.fit(rows, prep, FITTED, "action", counts)
    found = [*fit.coefficients.items(), ("intercept", fit.intercept)]
    return _plain(spark.createDataFrame(found, "term string, coefficient double"))


@query
def sigmoid_fit(spark, sf):
    """Slope and offset that calibrate a raw score: the number of suspicious tokens."""
    train, _ = features.temporal_split(_frame(spark, sf), V.CUTOFF)
    rows = settle(train.select(F.col("suspicious_token_count").cast("double").alias("raw"), "action"), "train")
    slope, offset = models.fit_sigmoid(rows, "raw", "action", models.class_counts(rows, "action"))
    return _plain(spark.createDataFrame([(slope, offset)], "slope double, offset double"))


@query
def target_validation(spark, sf):
    """Rows of each class in sets of training rows, and whether a model would be trained on them."""
    train, _ = features.temporal_split(_frame(spark, sf), V.CUTOFF)
    rows = settle(train.select("action", "tld_is_risky"), "train")
    sets = {"all": rows, "risky": rows.where("tld_is_risky = 1"), "actioned": rows.where("action = 1"), "none": rows.where("action > 1")}
    found = []
    for name, part in sets.items():
        n, positive = part.agg(F.count("*"), F.count_if(F.col("action") == 1)).first()
        try:
            models.class_counts(part, "action")
            found.append((name, n - positive, positive, 1))
        except ValueError:
            found.append((name, n - positive, positive, 0))
    return spark.createDataFrame(found, "rows_of string, negative long, positive long, accepted int")


@query
def numeric_coercion(spark, sf):
    """Text columns read as numbers; what isn't one is null."""
    raw_text = clean.apply_contract(V.raw_requests(spark, sf), settings.REQUEST_COLUMNS)
    counts = ["urls_removed", "urls_no_action", "copyright_owner_id"]
    return _plain(features.numeric_features(raw_text, counts).select("request_id", *counts))


@query
def model_choice(spark, sf):
    """Two given scores measured on the holdout, the better ranking first."""
    held = settle(features.temporal_split(_scored(spark, sf), V.CUTOFF)[1], "held")
    scores = {"naming": F.col("score"), "length": F.round(1 / F.col("domain_length"), 6)}
    rows = None
    for name, score in scores.items():
        measured = evaluate.ranking_measures(held.withColumn("_s", score), "_s")
        measured = measured.select(F.lit(name).alias("model"), "*")
        rows = measured if rows is None else rows.unionByName(measured)
    return _plain(models.best_first(rows).withColumn("chosen", (F.col("model") == models.choose_model(models.best_first(rows))).cast("int")))


# ---- selection ---------------------------------------------------------------------------


def _valued(spark, sf):
    return select.with_value(_candidates(spark, sf)).select(
        "request_id", "domain", "step_start", "expected_value", "cost_minutes"
    )


@query
def expected_value(spark, sf):
    return _plain(
        select.with_value(_candidates(spark, sf)).select("request_id", "domain", "expected_value")
    )


@query
def greedy_select(spark, sf):
    return _plain(select.greedy_select(_valued(spark, sf), cost="cost_minutes"))


@query
def greedy_select_fractional(spark, sf):
    """Costs in half minutes."""
    valued = _valued(spark, sf).withColumn("cost_minutes", F.col("cost_minutes") / 2)
    return _plain(select.greedy_select(valued, cost="cost_minutes", ticks_per_minute=2))


@query
def optimal_select_fractional(spark, sf):
    """Two and a half minutes for each candidate."""
    return _plain(select.optimal_select(_valued(spark, sf), cost=2.5, ticks_per_minute=2))


@query
def optimal_select(spark, sf):
    return _plain(select.optimal_select(_valued(spark, sf)))


@query
def optimal_select_mixed(spark, sf):
    return _plain(select.optimal_select(_valued(spark, sf), cost="cost_minutes"))


@query
def selection_uplift(spark, sf):
    return _plain(select.selection_uplift(settle(_valued(spark, sf), "valued")))


@query
def selection_uplift_mixed(spark, sf):
    """With unequal costs; several best selections may differ in size, so it is left out."""
    valued = settle(_valued(spark, sf), "valued")
    return _plain(select.selection_uplift(valued, cost="cost_minutes").drop("optimal_count"))


# ---- backtest ------------------------------------------------------------------------------


@query
def replay_ranked(spark, sf):
    held = _written_candidates(spark, sf).select(
        "request_id", "domain", "date", "score", "action", "domain_removal_rate"
    )
    return _plain(backtest.replay(held).drop("date"))


@query
def precision_at_k(spark, sf):
    return _plain(backtest.precision_at_k(_candidates(spark, sf)))


@query
def noise_avoided(spark, sf):
    held = select.with_value(_written_candidates(spark, sf))
    return _plain(backtest.noise_avoided(held, select.optimal_select(held)))


def _leads(spark, sf):
    """Domains first taken down after the scorer was fitted, flagged by their sightings in the feed."""
    dated = settle(_dated(spark, sf), "dated")
    scorer = radar.fit_pattern_scorer(radar.known_domains(dated, LEAD_CUTOFF))
    firsts = dated.groupBy("domain").agg(F.min("date").alias("date"))
    later = firsts.where(F.col("date") >= F.lit(LEAD_CUTOFF).cast("date"))
    seen = settle(radar.explode_hosts(certificates.parse_messages(V.takedown_feed(spark, sf))), "sightings")
    risky = radar.score_domains(seen.select("domain").distinct(), scorer).where(F.col("risk") >= 0.5)
    return backtest.feed_leads(seen.join(risky.select("domain"), "domain", "left_semi"), later)


@query
def lead_time(spark, sf):
    return _plain(_leads(spark, sf))


@query
def lead_time_summary(spark, sf):
    return _plain(backtest.lead_time_summary(_leads(spark, sf)))


# ---- radar ---------------------------------------------------------------------------------


@query
def ct_events(spark, sf):
    return _plain(_events(spark, sf))


@query
def new_domains(spark, sf):
    return _plain(radar.new_domains(_events(spark, sf)))


@query
def pattern_weights(spark, sf):
    return _plain(_scorer(spark, sf))


@query
def domain_scores(spark, sf):
    hosts = _events(spark, sf).select("domain").distinct()
    return _plain(radar.score_domains(hosts, _scorer(spark, sf)))


@query
def detect_bursts(spark, sf):
    return _plain(radar.detect_bursts(_events(spark, sf)))


@query
def watchlist(spark, sf):
    return _plain(radar.watchlist(_events(spark, sf), _scorer(spark, sf)))


# ---- streams, drained over everything available -----------------------------------------------


FEED_PARTS = 4


def _replayed(spark, sf, make_writer, delayed=None) -> None:
    """Play the certificate feed to a stream as it would arrive.

    Each stretch of days is written as JSON files, then the stream, started from its
    checkpoint, takes in what is new. Messages that are ``delayed`` come with the next stretch.
    """
    feed = fresh_folder(spark, "feed")
    messages = settle(V.certificate_messages(spark, sf), "messages")
    first, last = messages.agg(F.min("seen_micros"), F.max("seen_micros")).first()
    part = F.floor((F.col("seen_micros") - first) * FEED_PARTS / F.lit(last - first + 1))
    if delayed is not None:
        part = F.least(part + delayed.cast("int"), F.lit(FEED_PARTS - 1))
    for i in range(FEED_PARTS):
        messages.where(part == i).select("value").write.mode("append").text(feed)
        events = radar.explode_hosts(certificates.stream_messages(spark, feed))
        stream.drain(make_writer(events))


@query
def stream_new_domains(spark, sf):
    base = fresh_folder(spark, "store")
    _replayed(
        spark,
        sf,
        lambda events: certificates.store_new_domains(events, f"{base}/data", f"{base}/progress"),
    )
    return _plain(
        certificates.read_new_domains(spark, f"{base}/data").select("domain", "seen_at")
    )


@query
def stream_first_sightings(spark, sf):
    """Domains that were new to the stream when they came, each once."""
    base = fresh_folder(spark, "alerts")
    _replayed(
        spark,
        sf,
        lambda events: stream.first_sighting_writer(events, f"{base}/data", f"{base}/progress"),
    )
    return _plain(tables.read_table(spark, f"{base}/data").select("domain", "seen_at"))


@query
def stream_bursts(spark, sf):
    base = fresh_folder(spark, "bursts")
    _replayed(
        spark,
        sf,
        lambda events: stream.burst_writer(
            stream.closed_windows(events), f"{base}/counts", f"{base}/alerts", f"{base}/progress"
        ),
    )
    return _plain(tables.read_table(spark, f"{base}/alerts").drop("batch"))


@query
def stream_late_events(spark, sf):
    """Every twentieth message comes a stretch late: totals of all windows, and what came after they had closed."""
    base = fresh_folder(spark, "windows")
    _replayed(
        spark, sf, lambda events: stream.window_writer(events, base, f"{base}/state"), F.col("event_id") % 20 == 3
    )
    totals = stream.read_window_counts(spark, base)
    late = radar.window_counts(tables.read_table(spark, f"{base}/late").drop("batch", "window_start"))
    both = totals.join(late.withColumnRenamed("n", "n_late"), ["window_start", "signature"], "left")
    # the last correction of a window may be older than its last events in time
    fixed = tables.read_table(spark, f"{base}/corrections").groupBy("window_start", "signature").agg(F.max("n").alias("n_corrected"))
    return _plain(both.join(fixed, ["window_start", "signature"], "left").fillna(0, ["n_late", "n_corrected"]))


@query
def stream_watchlist(spark, sf):
    base = fresh_folder(spark, "watch")
    scorer = settle(_scorer(spark, sf), "scorer")
    _replayed(
        spark,
        sf,
        lambda events: stream.watchlist_writer(events, scorer, f"{base}/data", f"{base}/progress"),
    )
    return _plain(stream.read_watchlist(spark, f"{base}/data"))


# ---- models ----------------------------------------------------------------------------------


def _matrix(spark, sf, exclude_outcome_ratios=False):
    matrix = settle(
        model_frame.feature_matrix(_frame(spark, sf), exclude_outcome_ratios), "matrix"
    )
    return features.temporal_split(matrix, V.CUTOFF)


def _used(exclude: bool) -> list[str]:
    drop = settings.OUTCOME_FEATURES if exclude else ()
    return [f for f in settings.FEATURES if f not in drop]


@query
def baseline_scores(spark, sf):
    """Held-out rows scored and explained by the calibrated logistic regression."""
    train, held = _matrix(spark, sf, True)
    model = models.train_baseline(train, _used(True))
    scored = model.explain(model.predict_proba(held))
    return _plain(
        explain.flatten_reasons(scored, ["request_id", "domain", "action_probability"])
    )


@query
def scored_output(spark, sf):
    """The table that the scoring job leaves: score, reasons, rank and choice per candidate."""
    path = fresh_folder(spark, "scored")
    out = scoring.run_scoring(spark, _frame(spark, sf), path, V.owner_weights(spark, sf), V.CUTOFF)
    reasons = F.array_join(F.transform("top_features", lambda x: x["feature"]), ",")
    return _plain(out.withColumn("reasons", reasons).drop("top_features", "year_month", "date"))


class _FixedModel:
    """A model whose score and reasons are given, not learnt."""

    def predict_proba(self, df, out):
        return df.withColumn(out, model_frame.plain_score())

    def explain(self, df):
        return explain.with_top_features(df, _contributions())


@query
def scored_output_fixed(spark, sf):
    """The scoring job's written table, by a model that is given."""
    path = fresh_folder(spark, "scored")
    options = {"train": lambda past, used: _FixedModel()}
    out = scoring.run_scoring(spark, _frame(spark, sf), path, V.owner_weights(spark, sf), V.CUTOFF, **options)
    reasons = F.array_join(F.transform("top_features", lambda x: x["feature"]), ",")
    return _plain(out.withColumn("reasons", reasons).drop("top_features", "date"))


@query
def model_replay(spark, sf):
    """Precision at k of a replay that is ranked by the trained model."""
    matrix = settle(_frame(spark, sf).select("request_id", "domain", "date", "action", "domain_removal_rate", *_used(True)), "matrix")
    past, held = features.temporal_split(matrix, V.CUTOFF)
    replayed = backtest.replay(held, models.train_baseline(past, _used(True)))
    return _plain(backtest.precision_at_k(replayed))


@query
def challenger_scores(spark, sf):
    """The same by the calibrated boosted trees."""
    train, held = _matrix(spark, sf, True)
    model = models.train_challenger(train, _used(True))
    scored = model.explain(model.predict_proba(held))
    return _plain(
        explain.flatten_reasons(scored, ["request_id", "domain", "action_probability"])
    )


@query
def model_comparison(spark, sf):
    """Both models, with and without the ratios known only after the decision."""
    out = None
    # one matrix with all features serves both
    train, held = _matrix(spark, sf)
    for exclude in (False, True):
        fitted = {
            "baseline": models.train_baseline(train, _used(exclude)),
            "challenger": models.train_challenger(train, _used(exclude)),
        }
        row = models.compare_models(held, fitted).withColumn(
            "outcome_ratios", F.lit("excluded" if exclude else "kept")
        )
        out = row if out is None else out.unionByName(row)
    return _plain(out)


# ---- screens -----------------------------------------------------------------------------------


@query
def triage_view(spark, sf):
    held = _written_candidates(spark, sf)
    shown = views.triage_view(
        held.select("request_id", "domain", "step_start", "score", "weight", "action", *EXPLAINED),
        _contributions(),
    )
    reasons = F.array_join(F.transform("top_features", lambda x: x["feature"]), ",")
    return _plain(shown.withColumn("reasons", reasons).drop("top_features", *EXPLAINED))


@query
def outcomes_view(spark, sf):
    domains = _domains(spark, sf)
    return _plain(views.outcomes_view(_written_candidates(spark, sf, domains), V.requests(spark, sf, domains)))
