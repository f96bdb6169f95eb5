"""Calibrated triage classifiers on Spark ML.

Baseline: L2 logistic regression on imputed, standardised features with balanced class
weights. Challenger: boosted trees on imputed features. Both are wrapped in k-fold
sigmoid calibration; explanations come from one plain fit on all training rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from noticegrade import settings
from noticegrade.functions.prefix import rank_within
from noticegrade.functions.storage import settle, shared_folder
from noticegrade.operators.explain import (
    importance_contributions,
    linear_contributions,
    with_top_features,
)
from noticegrade.operators.evaluate import ranking_measures
from noticegrade.operators.features import numeric_features
from noticegrade.operators.boosting import Ensemble, boost, margin_of
from noticegrade.operators.fits import Regression, exact_medians, fit_logistic, fit_logistics, moments

LINEAR, TREES = "logistic_regression", "gradient_boosted_trees"


def impute_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median per feature, nulls left out; an all-null feature gets 0.0."""
    rows = settle(df.select(*(F.col(f).cast("double").alias(f) for f in features)), "features")
    medians = exact_medians(rows, features)[0]
    return df.sparkSession.createDataFrame(list(medians.items()), "feature string, median double")


@dataclass
class Preparation:
    """Training-row statistics, applied to any row as column expressions."""

    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def imputed(self, f: str) -> Column:
        return F.coalesce(F.col(f), F.lit(self.medians[f]))

    def scaled(self, f: str) -> Column:
        return (self.imputed(f) - F.lit(self.means[f])) / F.lit(self.scales[f])


def learn_preparations(
    rows: DataFrame, features: Sequence[str], rows_per_set: Sequence[int], scale: bool
) -> list[Preparation]:
    """Statistics of every training set from a few passes over ``rows``, in which no row is moved.

    Set i leaves out ``_fold`` i; the last set is all rows.
    """
    folds = len(rows_per_set) - 1
    sets = {i: F.col("_fold") != i for i in range(folds)} | {folds: F.lit(True)}
    medians = exact_medians(rows, features, sets)
    preparations = [Preparation(medians[i]) for i in sets]
    if scale:
        found = moments(rows, features, sets, medians, dict(enumerate(rows_per_set)))
        for i, prep in enumerate(preparations):
            prep.means = {f: mean for f, (mean, _) in found[i].items()}
            # a constant feature is centred and left unscaled
            prep.scales = {f: spread or 1.0 for f, (_, spread) in found[i].items()}
    return preparations


def _vector(df: DataFrame, columns: dict[str, Column], out: str) -> DataFrame:
    named = {f"_x_{f}": c for f, c in columns.items()}
    assembler = VectorAssembler(inputCols=list(named), outputCol=out)
    return assembler.transform(df.withColumns(named)).drop(*named)


@dataclass
class LinearFit:
    prep: Preparation
    coefficients: dict[str, float]
    intercept: float

    @classmethod
    def fit(
        cls, train: DataFrame, prep: Preparation, features: Sequence[str], label: str,
        counts: Mapping[int, int],
    ) -> LinearFit:
        return cls.fit_all(train, [F.lit(True)], [prep], features, label, [counts])[0]

    @classmethod
    def fit_all(
        cls, rows: DataFrame, sets: Sequence[Column], preps: Sequence[Preparation], features: Sequence[str], label: str,
        counts: Sequence[Mapping[int, int]],
    ) -> list[LinearFit]:
        """A fit for each set of rows (a condition); all of them share their passes over the rows."""
        regressions = []
        for inside, prep, c in zip(sets, preps, counts, strict=True):
            prepared = [[of[f] for f in features] for of in (prep.medians, prep.means, prep.scales)]
            n = sum(c.values())
            regressions.append(Regression(inside, *prepared, (n / (2 * c[0]), n / (2 * c[1]))))
        # penalty 1 on the summed loss
        found = fit_logistics(rows, features, label, regressions, 1.0)
        return [cls(prep, dict(zip(features, f.coefficients)), f.intercept) for prep, f in zip(preps, found)]

    def add_raw(self, df: DataFrame, out: str) -> DataFrame:
        margin = F.lit(self.intercept)
        for f, c in self.coefficients.items():
            margin = margin + self.prep.scaled(f) * F.lit(c)
        return df.withColumn(out, margin)

    def add_probability(self, df: DataFrame, out: str) -> DataFrame:
        return self.add_raw(df, out).withColumn(out, 1 / (1 + F.exp(-F.col(out))))

    def contributions(self) -> dict[str, Column]:
        p = self.prep
        return linear_contributions(
            list(self.coefficients), p.medians, p.means, p.scales, self.coefficients
        )


@dataclass
class TreeFit:
    """One fit by Spark ML, on one set of rows; ``BoostedFit`` grows the same kind of trees on several sets at once."""

    prep: Preparation
    features: list[str]
    model: object

    @classmethod
    def fit(
        cls, train: DataFrame, prep: Preparation, features: Sequence[str], label: str,
        counts: Mapping[int, int], *, trees: int, seed: int,
    ) -> TreeFit:
        vectors = _vector(train, {f: prep.imputed(f) for f in features}, "_features").select(
            "_features", F.col(label).cast("double").alias("_label")
        )
        shared_folder(train.sparkSession)  # lets the boosting rounds cut their lineage
        model = GBTClassifier(
            featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=4, stepSize=0.05,
            subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, checkpointInterval=10,
            cacheNodeIds=False,  # four splits are sooner made again than kept for every row
        ).fit(vectors)
        return cls(prep, list(features), model)

    def add_raw(self, df: DataFrame, out: str) -> DataFrame:
        vectors = _vector(df, {f: self.prep.imputed(f) for f in self.features}, "_features")
        scored = self.model.copy(
            {
                self.model.rawPredictionCol: "_raw",
                self.model.probabilityCol: "_probability",
                self.model.predictionCol: "_prediction",
            }
        ).transform(vectors)
        return scored.withColumn(out, vector_to_array("_probability")[1]).drop(
            "_features", "_raw", "_probability", "_prediction"
        )

    add_probability = add_raw

    def contributions(self) -> dict[str, Column]:
        weights = dict(zip(self.features, map(float, self.model.featureImportances.toArray())))
        return importance_contributions(self.features, self.prep.medians, weights)


@dataclass
class BoostedFit:
    """Boosted trees of one training set, grown together with those of others."""

    prep: Preparation
    features: list[str]
    ensemble: Ensemble
    depth: int

    @classmethod
    def fit_all(
        cls, rows: DataFrame, sets: Sequence[Column], preps: Sequence[Preparation], features: Sequence[str], label: str,
        counts: Sequence[Mapping[int, int]], *, trees: int, seed: int, depth: int = 4, **options,
    ) -> list[BoostedFit]:
        """A fit for each set of rows (a condition); all of them share their passes over the rows."""
        fills = [[prep.medians[f] for f in features] for prep in preps]
        found = boost(rows, features, label, sets, fills, trees=trees, depth=depth, seed=seed, **options)
        return [cls(prep, list(features), e, depth) for prep, e in zip(preps, found, strict=True)]

    def add_raw(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-2 * margin_of(self.ensemble, [self.prep.imputed(f) for f in self.features], self.depth))))

    add_probability = add_raw

    def importances(self) -> dict[str, float]:
        """Gain times training rows over all splits, in parts of their total."""
        gained = dict.fromkeys(self.features, 0.0)
        for _, _, feature, *_, gain, rows in self.ensemble.nodes(self.features):
            if feature is not None:
                gained[feature] += gain * rows
        total = sum(gained.values()) or 1.0
        return {f: g / total for f, g in gained.items()}

    def contributions(self) -> dict[str, Column]:
        return importance_contributions(self.features, self.prep.medians, self.importances())


@dataclass
class TriageModel:
    """Calibrated ensemble plus the plain fit that explains it."""

    feature_cols: list[str]
    model_type: str
    members: list[tuple[object, tuple[float, float] | None]]
    explainer: object
    calibrated: bool

    def predict_proba(self, df: DataFrame, out: str = "action_probability") -> DataFrame:
        """Add the probability of action: the mean over the calibrated members."""
        scored = numeric_features(df, self.feature_cols)
        total = F.lit(0.0)
        for i, (fit, sigmoid) in enumerate(self.members):
            if sigmoid is None:
                scored = fit.add_probability(scored, f"_p{i}")
                total = total + F.col(f"_p{i}")
            else:
                slope, offset = sigmoid
                scored = fit.add_raw(scored, f"_p{i}")
                total = total + 1 / (1 + F.exp(-(F.col(f"_p{i}") * slope + offset)))
        return scored.withColumn(out, total / len(self.members)).select(
            *(F.col(c) for c in df.columns), out
        )

    def explain(self, df: DataFrame, n: int = 3) -> DataFrame:
        """Add ``top_features`` from the uncalibrated fit on all training rows."""
        return with_top_features(
            numeric_features(df, self.feature_cols), self.explainer.contributions(), n
        )


def class_counts(train: DataFrame, label: str) -> dict[int, int]:
    """Rows per class. Raises ``ValueError`` unless there are exactly two."""
    counts = {
        r["y"]: r["n"]
        for r in train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()
    }
    if len(counts) != 2 or None in counts:
        raise ValueError("training needs both positive and negative labels")
    return counts


def with_folds(train: DataFrame, k: int, label: str, key: Sequence[str]) -> DataFrame:
    """Add ``_fold`` 0..k-1: each class is dealt round in the order of its keys' hashes.

    Folds of a class differ by one row at most, whatever the size of the class.
    """
    order = [F.xxhash64(*key).asc(), *(F.col(c).asc() for c in key)]
    ranked = rank_within(train, [label], order, "_rank")
    return ranked.withColumn("_fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank")


def fit_sigmoid(
    df: DataFrame, raw: str, label: str, counts: Mapping[int, int]
) -> tuple[float, float]:
    """Slope and offset of the sigmoid that maps a raw score to a probability.

    Targets are pulled in from 0 and 1 by the class sizes.
    """
    high, low = (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    fitted = fit_logistic(df.select(F.col(raw).alias("_raw"), target.alias("_target")), [F.col("_raw")], F.col("_target"))
    return fitted.coefficients[0], fitted.intercept


def _train(fit_class, model_type, train, features, label, key, parallelism, **options) -> TriageModel:
    features = list(features)
    rows = numeric_features(train, features).select(*key, *features, F.col(label).cast("int").alias(label))
    counts = class_counts(rows, label)
    folds = min(3, min(counts.values()))
    # every fit below iterates over these rows; write them once
    rows = settle(with_folds(rows, max(folds, 1), label, key), "training")
    sets = folds if folds > 1 else 0
    fold_counts = {
        i: {y: 0 for y in counts} for i in range(max(folds, 1))
    }
    for r in rows.groupBy("_fold", label).agg(F.count("*").alias("n")).collect():
        fold_counts[r["_fold"]][r[label]] = r["n"]
    set_counts = [{y: n - fold_counts[i][y] for y, n in counts.items()} for i in range(sets)]
    set_counts.append(counts)
    preparations = learn_preparations(
        rows, features, [sum(c.values()) for c in set_counts], scale=fit_class is LinearFit
    )

    inside = [F.col("_fold") != i for i in range(sets)] + [F.lit(True)]
    together = fit_class.fit_all(rows, inside, preparations, features, label, set_counts, **options)

    def fit(i: int):
        fitted = together[i]
        if i == sets:
            return fitted, None
        held_out = settle(fitted.add_raw(rows.where(F.col("_fold") == i), "_out").select("_out", label), "held_out")
        return fitted, fit_sigmoid(held_out, "_out", label, fold_counts[i])

    spark = rows.sparkSession
    with ThreadPool(max(1, min(parallelism, sets + 1))) as pool:
        fits = pool.map(inheritable_thread_target(spark)(fit), range(sets + 1))
    explainer = fits[-1][0]
    return TriageModel(features, model_type, fits[:-1] or fits, explainer, bool(sets))


def train_baseline(
    train: DataFrame,
    features: Sequence[str] = settings.FEATURES,
    label: str = "action",
    key: Sequence[str] = ("request_id", "domain"),
    *,
    parallelism: int = 4,
) -> TriageModel:
    """Calibrated logistic regression. All fits share their passes; ``parallelism`` of them are calibrated at the same time."""
    return _train(LinearFit, LINEAR, train, features, label, key, parallelism)


def train_challenger(
    train: DataFrame,
    features: Sequence[str] = settings.FEATURES,
    label: str = "action",
    key: Sequence[str] = ("request_id", "domain"),
    *,
    trees: int = 250,
    seed: int = settings.SEED,
    parallelism: int = 4,
) -> TriageModel:
    """Calibrated boosted trees. All fits share their passes; ``parallelism`` of them are calibrated at the same time."""
    return _train(
        BoostedFit, TREES, train, features, label, key, parallelism, trees=trees, seed=seed
    )


def compare_models(
    holdout: DataFrame, models: dict[str, TriageModel], label: str = "action"
) -> DataFrame:
    """ROC AUC and average precision per model on the holdout, best ranking first."""
    measured = None
    for name, model in models.items():
        scored = model.predict_proba(holdout, "_score")
        row = ranking_measures(scored, "_score", label).select(F.lit(name).alias("model"), "*")
        measured = row if measured is None else measured.unionByName(row)
    return best_first(measured)


def best_first(measured: DataFrame) -> DataFrame:
    return measured.orderBy(F.col("average_precision").desc(), "model")


def choose_model(comparison: DataFrame) -> str:
    """Name of the model that ranks the holdout best."""
    return comparison.first()["model"]
