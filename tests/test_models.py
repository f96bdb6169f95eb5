import datetime as dt
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticegrade.operators import evaluate as E
from noticegrade.operators import explain as X
from noticegrade.operators import models as Mo
from noticegrade.plans import registered

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 5, 1] + [0, 20, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 0.3 * (x[:, 1] - 20) - 1)))).astype(int)
    x[rng.random((n, 3)) < 0.1] = np.nan
    x[:, 2] = np.nan  # a feature without any value
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [
        (i, f"d{i}", *(None if np.isnan(v) else float(v) for v in r), int(t))
        for i, (r, t) in enumerate(zip(*data))
    ]
    return spark.createDataFrame(rows, "request_id long, domain string, a double, b double, c double, action int")


def logistic(x, y, weights, penalty):
    """Newton's method; ``penalty`` on the squared coefficients, none on the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta, reg = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (weights * (y - p)) - reg @ beta
        beta += np.linalg.solve(z.T @ (z * (weights * p * (1 - p))[:, None]) + reg, grad)
    return beta


def test_baseline_fits_the_weighted_penalised_regression(frame, data):
    x, y = data
    model = Mo.train_baseline(frame, FEATURES)
    assert model.calibrated and len(model.members) == 3
    medians = np.array([np.nanmedian(x[:, 0]), np.nanmedian(x[:, 1]), 0.0])
    filled = np.where(np.isnan(x), medians, x)
    scale = filled.std(axis=0)
    scale[scale == 0] = 1.0
    scaled = (filled - filled.mean(axis=0)) / scale
    prep = model.explainer.prep
    assert [prep.medians[f] for f in FEATURES] == pytest.approx(list(medians))
    assert [prep.means[f] for f in FEATURES] == pytest.approx(list(filled.mean(axis=0)))
    assert [prep.scales[f] for f in FEATURES] == pytest.approx(list(scale))
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = logistic(scaled, y, weights, 1.0)
    got = [model.explainer.coefficients[f] for f in FEATURES] + [model.explainer.intercept]
    assert got == pytest.approx(list(beta), abs=1e-3)
    scored = model.explain(model.predict_proba(frame))
    row = scored.orderBy("request_id").first()
    assert 0 < row["action_probability"] < 1
    effects = dict(zip(FEATURES, scaled[0] * beta[:3]))
    first = max(effects, key=lambda f: abs(effects[f]))
    top = row["top_features"]
    assert len(top) == 3 and top[0]["feature"] == first
    assert top[0]["contribution"] == pytest.approx(effects[first], abs=1e-2)
    assert top[0]["direction"] == ("up" if effects[first] >= 0 else "down")
    # probabilities of the positives and of all rows come out right on the whole
    mean = scored.agg(F.avg("action_probability")).first()[0]
    assert mean == pytest.approx(y.mean(), abs=0.03)


def test_sigmoid_matches_its_definition(spark):
    rng = np.random.default_rng(9)
    raw, y = rng.normal(size=300), None
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 * raw - 0.5)))).astype(int)
    df = spark.createDataFrame([(float(r), int(t)) for r, t in zip(raw, y)], "raw double, y int")
    pos, neg = int(y.sum()), int((1 - y).sum())
    slope, offset = Mo.fit_sigmoid(df, "raw", "y", {1: pos, 0: neg})
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta = logistic(raw[:, None], target, np.ones(300), 0.0)
    assert (slope, offset) == pytest.approx(tuple(beta), abs=1e-3)


def test_challenger_ranks_and_models_compare(frame):
    challenger = Mo.train_challenger(frame, FEATURES, trees=5)
    baseline = Mo.train_baseline(frame, FEATURES)
    table = Mo.compare_models(frame, {"baseline": baseline, "challenger": challenger})
    rows = table.collect()
    assert {r["model"] for r in rows} == {"baseline", "challenger"}
    assert rows[0]["average_precision"] >= rows[1]["average_precision"]
    assert Mo.choose_model(table) == rows[0]["model"]
    assert min(r["roc_auc"] for r in rows) > 0.7
    top = challenger.explain(frame).first()["top_features"]
    assert len(top) == 3 and abs(top[0]["contribution"]) >= abs(top[1]["contribution"])
    single = E.roc_auc(baseline.predict_proba(frame, "score")).first()[0]
    assert single == pytest.approx([r["roc_auc"] for r in rows if r["model"] == "baseline"][0])


@pytest.mark.parametrize("name", ["challenger_scores", "model_comparison"])
def test_registered_queries_fit_all_trees(monkeypatch, name):
    asked, signature = [], inspect.signature(Mo.train_challenger)

    def train(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["trees"])
        raise InterruptedError

    monkeypatch.setattr(registered, "_matrix", lambda *_: (None, None))
    monkeypatch.setattr(registered.models, "train_baseline", lambda *_: None)
    monkeypatch.setattr(registered.models, "train_challenger", train)
    with pytest.raises(InterruptedError):
        registered.QUERIES[name](None, None)
    assert asked == [250]


def test_labels_must_have_two_classes(frame):
    with pytest.raises(ValueError, match="both positive and negative"):
        Mo.train_baseline(frame.where("action = 1"), FEATURES)


def test_one_row_of_a_class_is_left_uncalibrated(frame):
    one = frame.where("action = 0").limit(30).unionByName(frame.where("action = 1").limit(1))
    model = Mo.train_baseline(one, FEATURES)
    assert not model.calibrated and len(model.members) == 1
    assert all(0 <= r[0] <= 1 for r in model.predict_proba(one).select("action_probability").collect())


def test_small_classes_are_dealt_over_the_folds(frame):
    few = frame.where("action = 0").unionByName(frame.where("action = 1").limit(3))
    counts = Mo.class_counts(few, "action")
    folds = Mo.with_folds(few, 3, "action", ["request_id"])
    assert {r["_fold"] for r in folds.where("action = 1").collect()} == {0, 1, 2}


def test_reasons_are_ordered_by_size_then_feature(spark):
    df = spark.createDataFrame([(1, 1.0, -2.0, 1.0, 0.5)], "i int, p double, q double, r double, s double")
    out = X.with_top_features(df, {c: F.col(c) for c in "pqrs"})
    rows = X.flatten_reasons(out, ["i"]).orderBy("position").collect()
    assert [(r["feature"], r["direction"]) for r in rows] == [("q", "down"), ("p", "up"), ("r", "up")]


def test_small_and_uneven_classes_are_dealt_evenly(spark):
    """Seven rows of two classes can be trained on, and folds of a class differ by one row at most."""
    rows = [(i, f"d{i}", float(i), float(i % 2), 0.0, int(i < 3)) for i in range(7)]
    small = spark.createDataFrame(rows, "request_id long, domain string, a double, b double, c double, action int")
    model = Mo.train_baseline(small, FEATURES)
    assert model.calibrated and len(model.members) == 3
    many = spark.range(2000).select("id", (F.col("id") % 10 == 0).cast("int").alias("action"))
    sizes = Mo.with_folds(many, 3, "action", ["id"]).groupBy("action", "_fold").count().collect()
    for y, n in ((0, 1800), (1, 200)):
        own = [r["count"] for r in sizes if r["action"] == y]
        assert sum(own) == n and len(own) == 3 and max(own) - min(own) <= 1


def test_scored_output_ranks_selects_and_explains(spark, tmp_path):
    """The scoring job from the test tables to the written table, and what the screens need of it."""
    from noticegrade.functions.storage import discard, settle
    from noticegrade.plans import model_frame, scoring
    from noticegrade.sources import views as V

    sf = "/root/testdata/sf0.001"
    frame = model_frame.model_frame(*V.written(spark, sf))
    out = scoring.run_scoring(spark, frame, str(tmp_path / "scored"), V.owner_weights(spark, sf), V.CUTOFF)
    rows = out.collect()
    held = frame.where(F.col("date") >= V.CUTOFF)
    assert len(rows) == held.select("request_id", "domain").distinct().count() > 0
    by_step = {}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["expected_value"] == pytest.approx(r["score"] * r["weight"])
        assert len(r["top_features"]) == 3
        by_step.setdefault(r["step_start"], []).append(r)
    for step in by_step.values():
        best = sorted(step, key=lambda r: (-r["score"], r["request_id"], r["domain"]))
        assert [r["rank"] for r in best] == list(range(1, len(step) + 1))
        valued = sorted((r["expected_value"] for r in step), reverse=True)
        assert sorted((r["expected_value"] for r in step if r["selected"]), reverse=True) == valued[:20]
    kept = settle(spark.range(3), "few")
    assert kept.count() == 3 and discard(spark) > 0 and discard(spark) == 0


def test_tree_rounds_keep_no_node_ids(spark):
    rows = spark.createDataFrame([(float(k), k % 2) for k in range(40)], "a double, action int")
    fit = Mo.TreeFit.fit(rows, Mo.Preparation({"a": 0.0}), ["a"], "action", {0: 20, 1: 20}, trees=2, seed=1)
    assert not fit.model.getOrDefault("cacheNodeIds")


def test_reasons_sort_without_a_compared_pair_at_a_time(spark):
    rows = spark.createDataFrame([(1, -2.0, 2.0, 0.5, float("nan"))], "id int, a double, b double, c double, d double")
    out = X.with_top_features(rows, {c: F.col(c) for c in "abc"})
    assert [r["feature"] for r in out.first()["top_features"]] == ["a", "b", "c"]
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scoring_by_a_given_model_writes_no_rows_that_no_step_reads(spark, tmp_path, monkeypatch):
    from noticegrade.plans import registered, scoring
    from noticegrade.sources import views as V

    sf, written, plain = "/root/testdata/sf0.001", [], scoring.settle
    monkeypatch.setattr(scoring, "settle", lambda df, name: (written.append(name), plain(df, name))[1])
    model = registered._FixedModel()
    frame = registered._frame(spark, sf)
    out = scoring.run_scoring(spark, frame, str(tmp_path / "given"), cutoff=V.CUTOFF, train=lambda past, used: model)
    assert written == ["valued", "chosen"]
    assert out.count() == frame.where(F.col("date") >= V.CUTOFF).count() > 0


def test_training_reads_written_rows(spark, monkeypatch):
    from noticegrade.plans import scoring

    seen = []
    monkeypatch.setattr(scoring, "settle", lambda df, name: (seen.append(name), df)[1])
    monkeypatch.setattr(scoring, "train_baseline", lambda past, used: used)
    assert scoring.train_on_written(spark.range(3), ["a"]) == ["a"] and seen == ["past"]
