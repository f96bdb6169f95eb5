import random

import pytest
from pyspark.sql import functions as F

from noticegrade.operators import features as Fe
from noticegrade.operators import history as H
from noticegrade.operators.joined import join_domains
from noticegrade.plans import model_frame as M
from noticegrade.sources import views as V

SF = "/root/testdata/sf0.001"


def by_id(df, *cols):
    return {r["request_id"]: (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols)) for r in df.collect()}


TRIPLE = [
    {"request_id": 1, "date": "2021-05-02", "removal_rate": 0.75},
    {"request_id": 2, "date": "2021-05-09", "removal_rate": 0.25},
    {"request_id": 3, "date": "2021-06-01", "removal_rate": 0.1},
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_history_is_strictly_earlier(make_requests, order):
    out = Fe.add_request_features(make_requests(*(TRIPLE[i] for i in order)))
    assert by_id(out, "org_historical_hit_rate") == {1: None, 2: 0.75, 3: 0.5}


def test_same_day_rows_do_not_see_each_other(make_requests):
    rows = [{"request_id": i, "removal_rate": float(i)} for i in (0, 1)]
    out = Fe.add_request_features(make_requests(*rows))
    assert by_id(out, "org_historical_hit_rate") == {0: None, 1: None}


def test_null_groups_and_null_days(make_requests):
    rows = [
        {"request_id": 1, "reporting_org_id": None, "date": "2024-01-01", "removal_rate": 1.0},
        {"request_id": 2, "reporting_org_id": None, "date": "2024-01-02", "removal_rate": 0.0},
        {"request_id": 3, "reporting_org_id": None, "date": None, "removal_rate": 0.0},
        {"request_id": 4, "reporting_org_id": None, "date": "2024-01-05", "removal_rate": None},
    ]
    out = Fe.add_request_features(make_requests(*rows))
    assert by_id(out, "org_historical_hit_rate") == {1: None, 2: 1.0, 3: None, 4: 0.5}
    assert by_id(out, "dow", "month")[3] == (None, None)


def test_domain_history(make_dated_domains):
    out = Fe.add_domain_features(
        make_dated_domains(
            {"request_id": 1, "domain": "kino.top", "removal_rate": 0.4},
            {"request_id": 2, "domain": "kino.top", "date": "2021-03-20", "removal_rate": 0.0},
        )
    )
    assert by_id(out, "domain_historical_hit_rate") == {1: None, 2: 0.4}


def test_appearances_and_age(make_dated_domains):
    days = ["2024-01-01", "2024-01-01", "2024-01-04", "2024-01-09"]
    df = make_dated_domains(*({"request_id": i, "date": d} for i, d in enumerate(days)))
    out = H.add_prior_appearances(df)
    assert by_id(out, "prior_appearances", "domain_age_days") == {
        0: (0, 0), 1: (0, 0), 2: (2, 3), 3: (3, 8),
    }


def test_changing_a_day_changes_no_feature_up_to_that_day(make_requests):
    rng = random.Random(1)
    rows = [
        {"request_id": i, "date": f"2024-01-{rng.randint(1, 20):02d}", "reporting_org_id": rng.randint(1, 3),
         "copyright_owner_id": rng.choice([None, 7, 8]), "removal_rate": rng.choice([None, 0.0, 0.25, 1.0])}
        for i in range(120)
    ]
    changed = [{**r, "removal_rate": 0.9} if r["date"] >= "2024-01-10" else r for r in rows]
    cols = ("org_historical_hit_rate", "owner_historical_hit_rate")
    before, after = (by_id(Fe.add_request_features(make_requests(*r)), *cols) for r in (rows, changed))
    early = [r["request_id"] for r in rows if r["date"] <= "2024-01-10"]
    assert {i: before[i] for i in early} == {i: after[i] for i in early}
    assert before != after


def test_history_of_hot_and_null_groups(make_requests):
    rng = random.Random(2)
    rows = [
        {"request_id": i, "date": "2024-01-05" if i % 3 else f"2024-01-{rng.randint(1, 9):02d}",
         "reporting_org_id": None if i % 5 == 0 else 1 + i % 2, "removal_rate": rng.random()}
        for i in range(300)
    ]
    got = by_id(H.add_prior_rate(make_requests(*rows), "reporting_org_id", "removal_rate", "x"), "x")
    assert len(got) == 300
    for r in rows:
        same = [o["removal_rate"] for o in rows if o["reporting_org_id"] == r["reporting_org_id"] and o["date"] < r["date"]]
        assert got[r["request_id"]] == (pytest.approx(sum(same) / len(same)) if same else None)


def test_request_shape(make_requests):
    zero = dict.fromkeys(("urls_specified", "urls_removed", "urls_no_action", "urls_not_in_index"), 0)
    rows = make_requests(
        {"request_id": 1, "urls_specified": 40, "urls_not_in_index": 10}, {"request_id": 2, **zero}
    )
    before = rows.columns
    out = Fe.add_request_features(rows)
    got = by_id(out, "not_in_index_ratio", "no_action_ratio", "dow", "month")
    assert got == {1: (0.25, 0.15, 6, 3), 2: (0.0, 0.0, 6, 3)}
    assert rows.columns == before


def test_request_features_accept_prefixes(make_requests):
    outcomes = ("urls_specified", "urls_no_action", "urls_not_in_index", "removal_rate")
    df = make_requests({}).withColumnsRenamed({c: f"request_{c}" for c in outcomes})
    out = Fe.add_request_features(df, "request_", "request_")
    for c in ("urls_log1p", "not_in_index_ratio", "no_action_ratio", "org_historical_hit_rate",
              "owner_historical_hit_rate", "dow", "month"):
        assert f"request_{c}" in out.columns


def test_naming(make_dated_domains):
    names = ["kinodirekt-live.xyz", "rda.co.uk", "live-sport-stream.top", None, "a1b22.unknowntld", "sports.com"]
    df = make_dated_domains(*({"request_id": i, "domain": d} for i, d in enumerate(names)))
    out = by_id(
        Fe.add_domain_features(df), "domain_has_suspicious_token", "suspicious_token_count", "tld",
        "tld_is_risky", "domain_length", "hyphen_count",
    )
    assert out[0] == (1, 1, "xyz", 1, 19, 1)
    assert out[1] == (0, 0, "co.uk", 0, 9, 0)
    assert out[2][:2] == (1, 3)
    assert out[3] == (0, 0, "", 0, 0, 0)
    assert out[4][2] == ""
    assert out[5][1] == 2
    ratios = by_id(Fe.add_domain_features(df), "digit_ratio")
    assert ratios[3] == 0.0 and ratios[4] == pytest.approx(3 / 16)


def test_label(make_requests):
    rates = [1.0, 0.5, 0.49, 0.0, None]
    df = make_requests(*({"request_id": i, "removal_rate": r} for i, r in enumerate(rates)))
    assert by_id(Fe.make_label(df, 0.5), "action") == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    assert "action" not in df.columns


def test_split_has_no_overlap(make_requests):
    days = ["2024-08-30", "2024-08-31", "2024-09-01", "2024-09-02"]
    df = make_requests(*({"request_id": i, "date": d} for i, d in enumerate(days)))
    train, holdout = Fe.temporal_split(df, "2024-09-01")
    assert set(by_id(train, "date")) == {0, 1} and set(by_id(holdout, "date")) == {2, 3}


def test_missing_feature_is_named(make_requests):
    with pytest.raises(ValueError, match="nonesuch"):
        Fe.numeric_features(make_requests({}), ["urls_removed", "nonesuch"])


def test_both_routes_to_the_model_frame_agree(spark):
    domains, requests = V.written(spark, SF)
    # an orphan domain and a blank domain take part
    domains = domains.withColumn(
        "request_id", F.when(F.col("request_id") % 50 == 0, -F.col("request_id") - 1).otherwise(F.col("request_id"))
    ).withColumn("domain", F.when(F.col("request_id") % 51 == 0, None).otherwise(F.col("domain")))
    joined = join_domains(domains, requests)

    def rows(frame):
        shown = M.feature_matrix(frame)
        return sorted(
            tuple("" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for v in r)
            for r in shown.collect()
        )

    slow = rows(M.model_frame_from_joined(joined))
    assert slow == rows(M.model_frame(domains, requests))


def test_a_narrow_model_frame_is_part_of_the_whole(spark, make_requests, monkeypatch):
    requests = make_requests({}, {"request_id": 7001, "date": "2021-03-20"})
    named = [(7000, "live-hd.xyz", 3), (7001, "live-hd.xyz", 0), (9, "a.com", 1), (7001, None, 2)]
    kept = [(*r, 4, 4 - r[2], 0, 0, r[2] / 4, False) for r in named]
    counts = "urls_removed int, urls_specified long, urls_no_action int, urls_not_in_index int, urls_pending int"
    domains = spark.createDataFrame(kept, f"request_id long, domain string, {counts}, removal_rate double, from_abuser boolean")
    whole, written = M.model_frame(domains, requests), []
    plain = M.settle
    monkeypatch.setattr(M, "settle", lambda df, name: (written.extend(df.columns), plain(df, name))[1])
    wanted = ["request_id", "domain", "request_no_action_ratio", "domain_historical_hit_rate", "tld_is_risky", "action"]
    narrow = M.model_frame(domains, requests, wanted)
    assert set(narrow.columns) == set(wanted)
    assert sorted(narrow.select(wanted).collect(), key=str) == sorted(whole.select(wanted).collect(), key=str)
    assert "reporting_org" not in written and "domain_urls_removed" not in written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_domains_are_summed_by_request_where_they_lie(spark):
    per_request = V.domains(spark, SF).groupBy("request_id").agg(F.sum("urls_removed"))
    assert plan(per_request).count("hashpartitioning(request_id") == 1
    assert "hashpartitioning(request_id#" in plan(per_request) and ", domain#" not in plan(per_request).split("hashpartitioning(")[1].split(")")[0]


def test_the_frame_writes_what_both_histories_read(spark, make_requests, monkeypatch):
    requests = make_requests({}, {"request_id": 7001, "date": "2021-03-20"})
    counts = "urls_removed int, urls_specified long, urls_no_action int, urls_not_in_index int, urls_pending int"
    rows = [(7000, "a.com", 1, 1, 0, 0, 0, 1.0, False), (7001, None, 0, 1, 1, 0, 0, 0.0, False)]
    domains = spark.createDataFrame(rows, f"request_id long, domain string, {counts}, removal_rate double, from_abuser boolean")
    written, plain = {}, M.settle
    monkeypatch.setattr(M, "settle", lambda df, name: (written.update({name: df.columns}), plain(df, name))[1])
    M.model_frame(domains, requests, ["request_id", "domain", "request_org_historical_hit_rate", "action"])
    assert list(written) == ["weighted", "attached"]
    assert "reporting_org" not in written["weighted"] and "request_urls_pending" not in written["weighted"]


def test_history_is_looked_up_by_a_number_first(spark):
    from noticegrade.functions.skew import lookup_join

    facts = spark.createDataFrame([("a", 1), (None, 1), ("a", None), ("b", 2)], "g string, day int")
    table = spark.createDataFrame([("a", 1, 10), (None, 1, 20), ("a", None, 30)], "g string, day int, v int")
    out = lookup_join(facts.hint("merge"), table, ["g", "day"], null_safe=True)
    assert {(r["g"], r["day"]): r["v"] for r in out.collect()} == {("a", 1): 10, (None, 1): 20, ("a", None): 30, ("b", 2): None}
    assert "SortMergeJoin [xxhash64(" in plan(out)
    # keys of another width still meet
    wide = table.withColumn("day", F.col("day").cast("long"))
    met = lookup_join(facts, wide, ["g", "day"], null_safe=True)
    assert sorted(r["v"] for r in met.collect() if r["v"]) == [10, 20, 30]


def test_the_model_frame_moves_no_request_columns_by_domain(spark, make_requests, monkeypatch):
    from noticegrade.plans import model_frame as frames

    written, settle = {}, frames.settle
    monkeypatch.setattr(frames, "settle", lambda df, name: (written.update({name: df.columns}), settle(df, name))[1])
    requests = make_requests(*({"request_id": i, "date": f"2021-03-{10 + i}", "removal_rate": i / 5} for i in (1, 2, 2, 3, 4)), {"request_id": 9, "date": None})
    rows = [(i, d, 10, 4, 0, 0, 0, (i or 0) / 10, False) for i in (1, 2, 3, 4, 4, 8, 9, None) for d in ("a.no", "b.no", None)]
    schema = "request_id long, domain string, urls_specified long, urls_removed int, urls_no_action int, urls_not_in_index int, urls_pending int, removal_rate double, from_abuser boolean"
    domains = spark.createDataFrame(rows, schema)
    got = frames.model_frame(domains, requests, columns=["request_id", "domain", "date", "request_org_historical_hit_rate", "domain_historical_hit_rate", "action"])
    assert sorted(written["attached"]) == ["_request_row", "date", "domain", "domain_removal_rate", "request_id"]
    found = got.collect()
    assert len(found) == len(rows) + 3 and got.columns[:2] == ["request_id", "domain"]  # a request is listed twice
    days = {i: 10 + i for i in range(1, 5)}
    for r in found:
        i = r["request_id"]
        earlier = [x for x in (1, 2, 2, 3, 4, 4) if i in days and x < i]
        want = sum(x / 10 for x in earlier) / len(earlier) if earlier else None
        assert r["domain_historical_hit_rate"] == (want if want is None else pytest.approx(want))
        assert (r["date"] is None) == (i not in days) and r["action"] == ((i or 0) >= 5)
    whole = frames.model_frame(domains, requests).columns
    assert whole.index("domain_urls_removed") < whole.index("date") < whole.index("request_urls_log1p") < whole.index("domain_historical_hit_rate") < whole.index("tld")


def test_cleaned_tables_are_not_written_beside_their_counts(monkeypatch):
    from noticegrade.plans import registered as R

    written = []
    monkeypatch.setattr(R, "settle", lambda df, name: written.append(name) or df)
    for name in ("domain_counts", "dirty_domains", "dirty_requests"):
        monkeypatch.setattr(R.V, name, lambda spark, *_: spark)
    monkeypatch.setattr(R.clean, "clean_domains", lambda df: df)
    monkeypatch.setattr(R.clean, "clean_requests", lambda df: df)

    class Counts:
        def sortWithinPartitions(self, *_):
            return self

    monkeypatch.setattr(R.F, "xxhash64", lambda *_: None)
    R._cleaned(Counts(), "")
    assert written == ["counts"]
