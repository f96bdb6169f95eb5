import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from noticegrade.operators import boosting as B
from noticegrade.operators import models as Mo

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    n = 1500
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 6, n), draw.random(n) ** 3, np.full(n, 7.0)])
    y = draw.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] + (x[:, 1] % 2) - 3 * x[:, 2])))
    data = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    data = [(i, None if i % 11 == 0 else a, *rest) for i, a, *rest in data]
    return spark.createDataFrame(data, "i long, a double, b double, c double, d double, y int").repartition(3).cache()


@pytest.mark.parametrize("blocks", [1 << 16, 100])
def test_trees_are_those_of_spark_ml_on_every_set(spark, rows, monkeypatch, blocks):
    monkeypatch.setattr(B, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(B, "KEPT", 2)
    monkeypatch.setattr(B, "WRITTEN", 4)
    sets = [F.col("i") % 3 != 0, F.lit(True)]
    preps = [Mo.Preparation(dict.fromkeys(FEATURES, fill)) for fill in (0.1, -0.2)]
    fits = Mo.BoostedFit.fit_all(rows, sets, preps, FEATURES, "y", [{}, {}], trees=8, seed=1, row_share=1.0, feature_share=1.0)
    for inside, prep, fit in zip(sets, preps, fits, strict=True):
        vectors = Mo._vector(rows, {f: prep.imputed(f) for f in FEATURES}, "x").withColumn("y", F.col("y").cast("double"))
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=8, maxDepth=4, stepSize=0.05, subsamplingRate=1.0, featureSubsetStrategy="all")
        model = model.fit(vectors.where(inside))
        theirs = {r["i"]: r["p"] for r in model.transform(vectors).select("i", vector_to_array("probability")[1].alias("p")).collect()}
        ours = {r["i"]: r["p"] for r in fit.add_raw(rows, "p").select("i", "p").collect()}
        assert ours == pytest.approx(theirs, abs=1e-9)
        want = dict(zip(FEATURES, map(float, model.featureImportances.toArray())))
        assert fit.importances() == pytest.approx(want, abs=1e-9)


def test_a_tree_is_grown_on_its_part_of_the_rows_wherever_they_lie(rows):
    prep, one = Mo.Preparation(dict.fromkeys(FEATURES, 0.0)), [F.lit(True)]
    grow = lambda df, **options: Mo.BoostedFit.fit_all(df, one, [prep], FEATURES, "y", [{}], trees=6, seed=7, **options)[0].ensemble.nodes(FEATURES)
    nodes, again = grow(rows), grow(rows.repartition(7))
    assert [n[:5] for n in nodes] == [n[:5] for n in again]
    assert [n[6] for n in nodes] == pytest.approx([n[6] for n in again])
    roots = {n[0]: n[9] for n in nodes if n[1] == 0}
    assert len(set(roots.values())) > 3 and all(1100 < r < 1300 for r in roots.values())
    few = {n[2] for n in grow(rows, feature_share=0.25) if n[1] == 0}
    assert len(few) > 1  # each node has its own features


def test_passes_don_t_follow_the_number_of_sets(spark, rows, monkeypatch):
    passes, sums = [], B._sums
    monkeypatch.setattr(B, "_sums", lambda *args: passes.append(1) or sums(*args))
    fills = [[0.0] * 4] * 4
    B.boost(rows, FEATURES, "y", [F.col("i") % 3 != k for k in range(3)] + [F.lit(True)], fills, trees=5)
    assert len(passes) <= 5 * 4
    with pytest.raises(Exception, match="not a number"):
        B.boost(rows.withColumn("c", F.lit(float("nan"))), FEATURES, "y", [F.lit(True)], [[0.0] * 4], trees=1)


def test_limits_of_bins():
    assert list(B.bin_limits(np.array([3.0, 1.0, 1.0, 2.0]))) == [1.5, 2.5]
    assert len(B.bin_limits(np.full(9, 2.0))) == len(B.bin_limits(np.zeros(0))) == 0
    limits = B.bin_limits(np.arange(1000.0))
    assert len(limits) == 31 and np.diff(limits).min() >= 31 and np.diff(limits).max() <= 32
