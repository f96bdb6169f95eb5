"""Prefix sums, quantiles, evaluation, ranking and selection against brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticegrade.functions import prefix
from noticegrade.functions.skew import lookup_join, top_k_per_group
from noticegrade.operators import backtest as B
from noticegrade.operators import evaluate as E
from noticegrade.operators import select as Se

DAY = dt.date(2024, 1, 1)


def test_lookup_join_with_many_hot_and_null_keys(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 300).alias("k"))
    table = spark.range(-1, 299).select(F.when(F.col("id") >= 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    for null_safe in (False, True):
        got = {r["id"]: r["v"] for r in lookup_join(df, table, ["k"], null_safe=null_safe).collect()}
        assert len(got) == 9000 and got[7] == (-2 if null_safe else None)
        assert all(got[i] == (None if i % 300 == 299 else 2 * (i % 300)) for i in got if i % 7)


def test_running_sums_match_a_plain_window(spark):
    rng = random.Random(3)
    rows = [(g, v, rng.randint(1, 9)) for g in ("a", "b", None) for v in
            {rng.choice([0.0, -3.5, 1e6, -1e6, rng.random(), rng.gauss(0, 50)]) for _ in range(80)}]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for descending in (False, True):
        order = F.col("v").desc() if descending else F.col("v").asc()
        w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        plain = df.withColumn("b", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn(
            "t", F.sum("n").over(Window.partitionBy("g"))
        )
        got = prefix.running_before(
            df, ["g"], "v", {"n": "b"}, totals={"n": "t"}, descending=descending
        )
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_ranks_of_one_cell_and_of_clustered_scores(spark):
    """All rows in one (group, score), null ids included, and scores that differ in the last digits."""
    rows = [("a", 0.5, None if i % 3 == 0 else i) for i in range(500)] + [("b", 0.3 + i * 1e-13, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, id long").repartition(16)
    order = [F.col("s").desc(), F.col("id").asc()]
    ranked = prefix.rank_within(df, ["g"], order, "rank")
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got, want = (sorted((r["g"], r["rank"], r["s"], r["id"] or -1) for r in x.collect()) for x in (ranked, plain))
    assert got == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"one": [2.0], "ties": [1.0] * 50 + [2.0] * 3, "wide": list(rng.normal(0, 1000, 101)),
              "even": list(rng.random(40))}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    rows += [("even", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "hi": 1.0}
    got = {r["g"]: r for r in prefix.exact_quantiles(df, ["g"], "v", qs).collect()}
    for g, vs in groups.items():
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q)), (g, name)


def graded(n=400, seed=5):
    rng = np.random.default_rng(seed)
    score = np.round(rng.random(n), 2)
    return score, (rng.random(n) < score).astype(int)


def test_ranking_measures_match_their_definitions(spark):
    score, label = graded()
    df = spark.createDataFrame(
        [(float(s), int(y)) for s, y in zip(score, label)], "score double, action int"
    )
    pos, neg = score[label == 1], score[label == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    points, ap, last = [], 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        chosen = label[score >= t]
        precision, recall = chosen.mean(), chosen.sum() / label.sum()
        points.append((t, precision, recall))
        ap += (recall - last) * precision
        last = recall
    got = E.ranking_measures(df).first()
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    assert E.roc_auc(df).first()[0] == pytest.approx(auc)
    curve = E.pr_curve(df).orderBy(F.col("threshold").desc_nulls_last()).collect()
    assert tuple(curve[-1]) == (None, 1.0, 0.0)
    assert [tuple(r) for r in curve[:-1]] == [pytest.approx(p) for p in points]


def test_calibration_curve(spark):
    score, label = graded()
    df = spark.createDataFrame(
        [(float(s), int(y)) for s, y in zip(score, label)], "score double, action int"
    )
    edges = np.quantile(score, np.linspace(0, 1, 11))[1:-1]
    bins = np.searchsorted(edges, score)
    got = {r["bin"]: r for r in E.calibration_curve(df).collect()}
    assert set(got) == set(bins)
    for b in set(bins):
        assert got[b]["mean_predicted"] == pytest.approx(score[bins == b].mean())
        assert got[b]["fraction_positive"] == pytest.approx(label[bins == b].mean())


def ranked_input(spark, n=600):
    rng = random.Random(6)
    rows = [
        # one step holds most rows and one score most of those, across id blocks
        (rng.randint(0, 2**23), f"d{i}.com" if i % 40 else None, DAY + dt.timedelta(days=0 if i % 3 else i % 5),
         0.5 if i % 2 else round(rng.random(), 3), i % 2, rng.random())
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "request_id long, domain string, date date, score double, action int, domain_removal_rate double"
    )


def test_rank_all_matches_a_plain_window(spark):
    df = B.with_step(ranked_input(spark))
    w = Window.partitionBy("step_start").orderBy(F.col("score").desc(), "request_id", "domain")
    plain = df.withColumn("rank", F.row_number().over(w))
    assert sorted(map(str, B.rank_all(df).collect())) == sorted(
        map(str, plain.withColumn("rank", F.col("rank").cast("long")).collect())
    )


def test_replay_hides_then_reveals(spark):
    df = ranked_input(spark)
    out = B.replay(df, step_days=1)
    assert out.count() == df.count()
    flipped = df.withColumn("action", 1 - F.col("action")).withColumn("domain_removal_rate", F.lit(0.0))
    keys = ["request_id", "domain", "step_start", "rank"]
    assert sorted(map(str, out.select(keys).collect())) == sorted(
        map(str, B.replay(flipped).select(keys).collect())
    )
    weekly = B.replay(df, step_days=7).select("step_start").distinct().count()
    assert weekly < out.select("step_start").distinct().count()


def test_precision_at_k_by_hand(spark):
    rows = [(i, f"d{i}", DAY, 1 - i / 10, int(i in (0, 1, 3))) for i in range(5)]
    rows += [(9, "x", DAY + dt.timedelta(1), 0.3, 1)]
    df = spark.createDataFrame(
        rows, "request_id long, domain string, step_start date, score double, action int"
    )
    got = {(r["step_start"], r["k"]): (r["precision"], r["n"]) for r in B.precision_at_k(df, ks=[1, 2, 4, 10]).collect()}
    assert got[DAY, 1] == (1.0, 1) and got[DAY, 2] == (1.0, 2)
    assert got[DAY, 4] == (0.75, 4) and got[DAY, 10] == (0.6, 5)
    assert got[DAY + dt.timedelta(1), 10] == (1.0, 1)


def test_large_top_k_goes_through_salts(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    out = top_k_per_group(df, ["g"], [F.col("id").desc()], 1500, "r", spread_by=["id"])
    assert out.count() == 3000 and out.agg(F.min("id")).first()[0] == 2000


def candidates(spark, groups=25, seed=7, free=False):
    rng = random.Random(seed)
    rows = [
        (i, f"d{i}.com", DAY + dt.timedelta(days=i % groups), rng.choice([0.0, rng.random(), 0.5]),
         rng.randint(0 if free else 1, 9)) for i in range(groups * 9)
    ]
    df = spark.createDataFrame(
        rows, "request_id long, domain string, step_start date, expected_value double, cost_minutes long"
    )
    return rows, df


def totals(df):
    rows = df.groupBy("step_start").agg(F.sum("expected_value"), F.sum("cost_minutes")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


@pytest.mark.parametrize("budget", [7, 20])
def test_optimal_selection_is_the_best_and_greedy_is_not_better(spark, budget):
    rows, df = candidates(spark, free=True)
    best = {}
    for day in {r[2] for r in rows}:
        items = [(r[3], r[4]) for r in rows if r[2] == day]
        best[day] = max(
            sum(v for v, _ in s) for n in range(len(items) + 1) for s in itertools.combinations(items, n)
            if sum(c for _, c in s) <= budget
        )
    optimal = totals(Se.optimal_select(df, budget, "cost_minutes"))
    greedy = totals(Se.greedy_select(df, budget, "cost_minutes"))
    for day, value in best.items():
        got, cost = optimal.get(day, (0.0, 0))
        assert got == pytest.approx(value) and cost <= budget
        naive, naive_cost = greedy.get(day, (0.0, 0))
        assert naive <= got + 1e-9 and naive_cost <= budget
    uplift = Se.selection_uplift(df, budget, "cost_minutes").collect()
    assert all(r["uplift"] >= -1e-9 for r in uplift) and any(r["uplift"] > 0 for r in uplift)


@pytest.mark.parametrize("budget", [1, 7, 12])
def test_ties_of_best_subsets_have_one_answer(spark, budget):
    """Few distinct values whose decimal sums aren't exact, so that many subsets tie."""
    rng = random.Random(budget)
    rows = [(i, rng.choice("ab"), DAY + dt.timedelta(days=i % 4), rng.choice([0.1, 0.2, 0.3, 0.4, 0.7, -1.0, 0.0, None]), rng.randint(1, 5))
            for i in range(44)]
    schema = "request_id long, domain string, step_start date, expected_value double, cost_minutes long"
    got = Se.optimal_select(spark.createDataFrame(rows, schema).repartition(5), budget, "cost_minutes")
    found = {r["request_id"] for r in got.collect()}
    for day in {r[2] for r in rows}:
        items = sorted((-r[3], r[0], r[4]) for r in rows if r[2] == day and (r[3] or 0) > 0)
        # the greatest total in tenths; of equal ones that without the last candidate they differ in
        best = max(
            (round(-10 * sum(items[i][0] for i in s)), tuple(-(i in s) for i in reversed(range(len(items)))))
            for n in range(len(items) + 1) for s in itertools.combinations(range(len(items)), n)
            if sum(items[i][2] for i in s) <= budget
        )
        want = {items[i][1] for i, chosen in zip(reversed(range(len(items))), best[1]) if chosen}
        assert found & {r[0] for r in rows if r[2] == day} == want


def test_greedy_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, "a", DAY, 9.0, 3), (2, "b", DAY, 8.0, 4), (3, "c", DAY, 0.1, 1), (4, "d", DAY, 0.0, 0), (5, "e", DAY, 99.0, 50)]
    df = spark.createDataFrame(
        rows, "request_id long, domain string, step_start date, expected_value double, cost_minutes long"
    )
    taken = Se.greedy_select(df, 6, "cost_minutes").collect()
    assert {r["request_id"]: r["cumulative_cost"] for r in taken} == {1: 3, 4: 0}


def test_uniform_cost_needs_no_search(spark):
    _, df = candidates(spark)
    best, naive = totals(Se.optimal_select(df, 10, 3)), totals(Se.greedy_select(df, 10, 3))
    assert {d: v[0] for d, v in best.items()} == pytest.approx({d: v[0] for d, v in naive.items()})


def test_negative_cost_raises(spark):
    df = spark.createDataFrame(
        [(1, "a", DAY, 1.0, -1)],
        "request_id long, domain string, step_start date, expected_value double, cost_minutes long",
    )
    with pytest.raises(Exception, match="negative cost"):
        Se.greedy_select(df, 5, "cost_minutes").collect()


@pytest.mark.parametrize(("cost", "taken"), [(2.5, 24), (0.5, 120)])
def test_fractional_costs_stay_within_the_budget(spark, cost, taken):
    rows = [(i, f"d{i}", DAY, 1.0 + i, cost) for i in range(500)]
    df = spark.createDataFrame(
        rows, "request_id long, domain string, step_start date, expected_value double, cost_minutes double"
    )
    for pick in (Se.greedy_select, Se.optimal_select):
        for price in ("cost_minutes", cost):
            got = pick(df, 60, price, ticks_per_minute=2).agg(F.count("*"), F.sum("cost_minutes")).first()
            assert tuple(got) == (taken, 60.0)
        with pytest.raises(Exception, match="no whole number of ticks"):
            pick(df, 60, "cost_minutes").collect()


def test_repeated_candidates_are_one_and_never_multiply(spark):
    """Spellings of a domain that cleaning made one, and blank domains of one request."""
    rows = [(1, "a.com", DAY, 0.9, 1, 0.5), (1, "a.com", DAY, 0.4, 0, 0.1), *[(2, None, DAY, 0.1 * i, 0, 0.0) for i in range(7)]]
    df = spark.createDataFrame(
        rows, "request_id long, domain string, date date, score double, action int, domain_removal_rate double"
    )
    out = B.replay(df).collect()
    assert sorted((r["request_id"], r["score"], r["rank"], r["action"]) for r in out) == [(1, 0.9, 1, 1), (2, pytest.approx(0.6), 2, 0)]
    ranked = B.rank_all(B.with_step(B.one_per_key(df)))
    with pytest.raises(Exception, match="candidate key is repeated"):
        B.reveal(ranked.drop("action"), df.select("request_id", "domain", "action")).collect()


def test_owner_weight_defaults_to_one(spark):
    df = spark.createDataFrame([(1, 0.5), (None, 0.5), (3, 0.5)], "copyright_owner_id long, score double")
    weights = spark.createDataFrame([(1, 3.0)], "copyright_owner_id long, weight double")
    out = Se.with_value(Se.add_owner_weight(df, weights)).collect()
    assert {r["copyright_owner_id"]: r["expected_value"] for r in out} == {1: 1.5, None: 0.5, 3: 0.5}


def test_lead_times(spark):
    flagged = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(3)), ("b", DAY)], "domain string, flagged_on date")
    hits = spark.createDataFrame([("a", DAY + dt.timedelta(10)), ("a", DAY + dt.timedelta(20)), ("b", DAY - dt.timedelta(2)), ("c", DAY)], "domain string, date date")
    leads = B.lead_times(flagged, hits)
    assert {r["domain"]: r["lead_days"] for r in leads.collect()} == {"a": 10, "b": -2}
    summary = B.lead_time_summary(leads).first()
    assert (summary["domains"], summary["flagged_ahead"], summary["lead_median"]) == (2, 1, 4.0)


def test_ranks_move_no_row_after_the_ranges(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id"), F.lit("x").alias("wide"))
    ranked = prefix.rank_within(df, ["g"], [F.col("id").desc()], "rank")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    assert sorted(r["rank"] for r in ranked.where("g = 1").collect()) == list(range(1, 168))
