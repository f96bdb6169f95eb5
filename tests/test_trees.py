"""Ensembles as node tables against the fitted model, a plain walk and wrong tables."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from noticegrade.operators import models as Mo
from noticegrade.operators import trees as Tr


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.gauss(0, 3), rng.choice([None, 1.0, 2.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").withColumn(
        "action", (F.col("a") * 2 + F.sin("b") + F.coalesce("c", F.lit(0.5)) > 1.9).cast("int")
    )
    prep = Mo.Preparation({"a": 0.5, "b": 0.0, "c": 1.0})
    return df, prep, Mo.TreeFit.fit(df, prep, ["a", "b", "c"], "action", {}, trees=7, seed=3)


def test_node_table_scores_as_the_model_does(fitted, spark):
    df, prep, fit = fitted
    nodes = Tr.tree_nodes(spark, fit.model, fit.features)
    assert nodes.select("tree").distinct().count() == 7
    scored = fit.add_probability(df, "by_model")
    scored = Tr.add_margin(scored, nodes, {f: prep.imputed(f) for f in fit.features}, 4)
    both = scored.select("by_model", Tr.margin_probability().alias("by_table")).collect()
    assert all(r["by_table"] == pytest.approx(r["by_model"], abs=1e-12) for r in both)
    assert len({round(r["by_table"], 9) for r in both}) > 10


def test_importances_are_the_models(fitted, spark):
    _, _, fit = fitted
    got = {r["feature"]: r["importance"] for r in Tr.node_importances(Tr.tree_nodes(spark, fit.model, fit.features)).collect()}
    want = dict(zip(fit.features, map(float, fit.model.featureImportances.toArray())))
    assert {f: got.get(f, 0.0) for f in want} == pytest.approx(want)


def test_leaves_ties_missing_values_and_other_roots(spark):
    nodes = [
        (5, 1, "a", 0.5, 2, 3, 0.0, 2.0), (5, 2, None, None, None, None, 1.0, 2.0), (5, 3, "b", -1.0, 6, 7, 0.0, 2.0),
        (5, 6, None, None, None, None, 10.0, 2.0), (5, 7, None, None, None, None, 100.0, 2.0),
        (9, 1, None, None, None, None, 0.25, 1.0),
    ]
    table = spark.createDataFrame(nodes, Tr.NODES)
    rows = [(0.5, 0.0, "x"), (0.6, -1.0, "x"), (0.6, None, None), (None, None, "x"), (0.6, 0.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, margin string")
    inputs = {"a": F.col("a"), "b": F.col("b")}
    got = Tr.add_margin(df, table, inputs, 2, out="z", root=1)
    assert got.columns == ["a", "b", "margin", "z"]
    assert [r["z"] for r in got.collect()] == [2.25, 20.25, 200.25, 200.25, 200.25]
    assert [r["z"] for r in Tr.add_margin(df, table.limit(0), inputs, 2, out="z").collect()] == [0.0] * 5
    with pytest.raises(Exception, match="deeper"):
        Tr.add_margin(df, table, inputs, 1, out="z", root=1).collect()


@pytest.mark.parametrize("bad", [
    [(0, 0, "z", 0.5, 1, 2, 0.0, 1.0), (0, 1, *[None] * 4, 1.0, 1.0), (0, 2, *[None] * 4, 1.0, 1.0)],
    [(0, 0, "a", None, 1, 2, 0.0, 1.0), (0, 1, *[None] * 4, 1.0, 1.0), (0, 2, *[None] * 4, 1.0, 1.0)],
    [(0, 0, "a", 0.5, 1, 2, 0.0, 1.0), (0, 1, *[None] * 4, 1.0, 1.0)],
    [(0, 0, *[None] * 4, 1.0, 1.0), (0, 0, *[None] * 4, 2.0, 1.0)],
])
def test_broken_tables_raise(spark, bad):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        Tr.add_margin(df, spark.createDataFrame(bad, Tr.NODES), {"a": F.col("a")}, 1)
