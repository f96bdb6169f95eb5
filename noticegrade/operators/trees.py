"""Boosted trees as a table of nodes, and scores from that table.

A node is (tree, node, feature, threshold, left, right, value, weight): a row goes left where its
feature is at most the threshold; a leaf has no feature. ``weight`` is the tree's share in the
margin. The table has at most trees * 2^(depth + 1) rows, whatever the number of training rows,
so it is a constant of the plan; scoring moves no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticegrade.functions.storage import fresh_folder

NODES = "tree int, node int, feature string, threshold double, left int, right int, value double, weight double"
NAMES = ["tree", "node", "feature", "threshold", "left", "right", "value", "weight"]
#: More nodes than this raise: the table goes to every task. 250 trees of depth 4 have 7,750.
MOST_NODES = 1 << 17


def tree_nodes(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """The node table of a fitted ensemble, with ``gain`` and training ``rows`` of each node.

    ``features`` names the model's inputs in their order. Splits must be on numbers.
    """
    path = fresh_folder(spark, "trees")
    model.save(path)
    weights = spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double")
    data = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    at = F.col("split.featureIndex")
    inner = at >= 0
    named = F.element_at(F.array(*map(F.lit, features)), F.when(inner, at + 1).otherwise(1))
    nodes = data.select(
        "tree", F.col("id").alias("node"), F.when(inner, named).alias("feature"),
        F.when(inner, F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"), F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("rows"),
    )
    return nodes.join(weights, "tree")


def node_importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): gain times training rows over all splits, in parts of their total.

    A feature that splits nowhere has no row.
    """
    splits = nodes.filter("feature is not null")
    gained = splits.groupBy("feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gained"))
    share = F.col("gained") / F.sum("gained").over(Window.partitionBy(F.lit(0)))  # a row for each feature
    return gained.select("feature", share.alias("importance"))


def _ensemble(nodes: DataFrame, features: Sequence[str], root: int) -> dict[str, list]:
    """All nodes as lists, children as places in them; -1 for the input of a leaf."""
    found = nodes.select(*NAMES).limit(MOST_NODES + 1).collect()
    if len(found) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes are too many to send to every task")
    found.sort(key=lambda n: (n["tree"], n["node"]))
    place = {(n["tree"], n["node"]): i for i, n in enumerate(found)}
    if len(place) < len(found):
        raise ValueError("a node is listed twice")
    known = {f: i for i, f in enumerate(features)}
    out: dict[str, list] = {"x": [], "threshold": [], "left": [], "right": [], "part": []}
    for n in found:
        leaf = n["feature"] is None
        sides = [None if leaf else place.get((n["tree"], n[c])) for c in ("left", "right")]
        if not leaf and (n["feature"] not in known or n["threshold"] is None or None in sides):
            raise ValueError(f"node {n['node']} of tree {n['tree']}: unknown feature, no threshold or a child is missing")
        out["x"].append(-1 if leaf else known[n["feature"]])
        out["threshold"].append(0.0 if leaf else n["threshold"])
        here = place[n["tree"], n["node"]]
        out["left"].append(here if leaf else sides[0])
        out["right"].append(here if leaf else sides[1])
        out["part"].append(n["value"] * n["weight"] if leaf else 0.0)
    out["roots"] = [i for (_, node), i in place.items() if node == root]
    return out


def _constant(values: list, kind: str) -> Column:
    """A list as one constant of the plan, which holds it once and not in every row."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def add_margin(df: DataFrame, nodes: DataFrame, inputs: dict[str, Column], depth: int, out: str = "margin", root: int = 0) -> DataFrame:
    """``df`` with the sum of weight times leaf value over all trees of ``nodes``.

    ``inputs`` gives each feature's value; a missing value goes right, as a number above every
    threshold would. ``depth`` is the number of splits from a root to the deepest leaf; a
    longer path raises. A table without nodes gives 0.0.
    """
    ensemble = _ensemble(nodes, list(inputs), root)
    kinds = {"x": "int", "threshold": "double", "left": "int", "right": "int", "part": "double", "roots": "int"}
    of = {name: _constant(values, kinds[name]) for name, values in ensemble.items()}
    rows = df.withColumn("_x", F.array(*(c.cast("double") for c in inputs.values())))

    def go(at: Column) -> Column:
        # a leaf's children are itself
        low = F.get(F.col("_x"), F.get(of["x"], at)) <= F.get(of["threshold"], at)
        return F.when(low, F.get(of["left"], at)).otherwise(F.get(of["right"], at))

    at = of["roots"]
    for _ in range(depth):
        at = F.transform(at, go)
    deeper = F.raise_error(F.lit("a tree is deeper than depth says")).cast("double")
    part = F.transform(at, lambda i: F.when(F.get(of["x"], i) >= 0, deeper).otherwise(F.get(of["part"], i)))
    return rows.withColumn(out, F.aggregate(part, F.lit(0.0), lambda total, v: total + v)).drop("_x")


def margin_probability(margin: str = "margin") -> Column:
    """The chance of the positive class under the log loss that the trees are boosted on."""
    return 1 / (1 + F.exp(-2 * F.col(margin)))
