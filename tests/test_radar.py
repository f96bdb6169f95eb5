import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noticegrade.operators import radar as R
from noticegrade.sources import certificates as C
from noticegrade.streaming import radar as St

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def message(hosts, minutes, issuer="CA", kind="certificate_update"):
    seen = (START + dt.timedelta(minutes=minutes)).timestamp()
    leaf = {"all_domains": hosts, "issuer": {"O": issuer}, "other": 1}
    return json.dumps({"message_type": kind, "data": {"leaf_cert": leaf, "seen": seen}})


@pytest.fixture(scope="module")
def scorer(spark):
    pirate = ["rojadirecta-live.xyz", "sport-stream.xyz", "watch-hd1.ru", "live-tv24.xyz", "free-futbol.ru"]
    other = ["bbc.co.uk", "newspaper.com", "garden-shop.net", "university.org", "bakery.com", "city-blog.net"]
    known = spark.createDataFrame(
        [(d, True) for d in pirate] + [(d, False) for d in other], "domain string, is_pirate boolean"
    )
    return R.fit_pattern_scorer(known)


def test_signals(spark):
    df = spark.createDataFrame([("live-sport24.co.uk",), ("plain.com",), ("co.uk",)], "domain string")
    got = {r[0]: set(r[1]) for r in df.select("domain", R.naming_signals(F.col("domain"))).collect()}
    assert got["live-sport24.co.uk"] == {"live", "sport", "t:live", "t:sport", "s:co.uk", "c:digit", "c:hyphen"}
    assert got["plain.com"] == {"plain", "s:com"}


def test_pirate_names_outrank_benign_ones(spark, scorer):
    names = ["new-live-stream.xyz", "sport-hd.ru", "library.org", "flowers.com", "zzz"]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    scored = R.score_domains(df.withColumn("note", F.lit("kept")), scorer).collect()
    risk = {r["domain"]: r["risk"] for r in scored}
    assert min(risk["new-live-stream.xyz"], risk["sport-hd.ru"]) > 0.5
    assert max(risk["library.org"], risk["flowers.com"]) < 0.5
    assert risk["zzz"] == 0.5 and all(0 <= r <= 1 for r in risk.values())
    assert {r["note"] for r in scored} == {"kept"}


def test_known_domains_use_only_the_time_before_the_cutoff(spark):
    rows = [("a.xyz", dt.date(2024, 1, 1), 0.9), ("a.xyz", dt.date(2024, 3, 1), 0.0), ("b.com", dt.date(2024, 1, 1), None),
            ("late.com", dt.date(2024, 3, 1), 1.0)]
    df = spark.createDataFrame(rows, "domain string, date date, domain_removal_rate double")
    assert {r[0]: r[1] for r in R.known_domains(df, "2024-02-01").collect()} == {"a.xyz": True, "b.com": False}


def test_hosts_are_normalised_and_one_event_each(spark):
    text = [message(["*.A.com", "a.com.", " b.NET "], 1), message(["c.com"], 2, kind="heartbeat"), "not json"]
    events = R.explode_hosts(C.parse_messages(spark.createDataFrame([(t,) for t in text], "value string")))
    rows = events.orderBy("domain").collect()
    assert [(r["domain"], r["issuer"]) for r in rows] == [("a.com", "CA"), ("b.net", "CA")]
    assert events.select(F.unix_seconds("seen_at")).first()[0] == int(START.timestamp()) + 60


def spike_feed():
    """A day of quiet, then forty alike names inside one quarter of an hour."""
    quiet = [(f"live-{i}.xyz", i * 60) for i in range(24)] + [(f"shop{i}.com", i * 15) for i in range(100)]
    spike = [(f"live-match{i}.xyz", 25 * 60 + i / 4) for i in range(40)]
    after = [("shopz.com", 30 * 60), ("shopz.com", 31 * 60)]
    return quiet, spike, after


def test_spike_is_flagged_and_quiet_is_not(spark):
    quiet, spike, after = spike_feed()
    df = spark.createDataFrame(
        [(d, START + dt.timedelta(minutes=m)) for d, m in quiet + spike + after], "domain string, seen_at timestamp"
    )
    flagged = R.detect_bursts(df).where("is_burst").collect()
    assert [(r["signature"], r["n"]) for r in flagged] == [("live+match|xyz", 40)]
    assert R.detect_bursts(df, window_minutes=60).where("is_burst").count() == 1


def test_streams_end_where_the_batch_does(spark, scorer, tmp_path):
    quiet, spike, after = spike_feed()
    feed, store = tmp_path / "feed", {n: str(tmp_path / n) for n in ("new", "counts", "alerts", "watch", "raw")}
    feed.mkdir()
    for i, part in enumerate((quiet, spike, after)):
        lines = [message([d, f"*.{d}"], m) for d, m in part]
        (feed / f"{i}.json").write_text("\n".join(lines) + "\n")
        # started again for each part, from its checkpoints
        def events():
            return R.explode_hosts(C.stream_messages(spark, str(feed)))

        St.drain(C.store_new_domains(events(), store["new"], str(tmp_path / "c1")))
        St.drain(St.burst_writer(St.closed_windows(events()), store["counts"], store["alerts"], str(tmp_path / "c2")))
        St.drain(St.watchlist_writer(events(), scorer, store["watch"], str(tmp_path / "c3")))
        St.drain(St.first_sighting_writer(events(), store["raw"], str(tmp_path / "c4")))
    batch = R.explode_hosts(C.read_messages(spark, str(feed)))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(
        C.read_new_domains(spark, store["new"]).select("domain", "seen_at"),
        R.new_domains(batch).select("domain", F.col("first_seen").alias("seen_at")),
    )
    alerts = spark.read.parquet(store["alerts"])
    columns = [c for c in alerts.columns if c != "batch"]
    assert same(alerts.select(columns), R.detect_bursts(batch).where("is_burst").select(columns))
    kept = ["domain", "sightings", "risk", "rank"]
    assert same(St.read_watchlist(spark, store["watch"], 20).select(kept), R.watchlist(batch, scorer, 20).select(kept))
    # each domain once, though "shopz.com" and others come again long after
    first = spark.read.parquet(store["raw"]).select("domain", "seen_at")
    assert same(first, R.new_domains(batch).select("domain", F.col("first_seen").alias("seen_at")))


def test_late_sightings_are_not_new_and_not_counted_twice(spark, tmp_path):
    """A feed out of order: what comes again late is no first sighting, but the store learns of it."""
    feed, store = tmp_path / "feed", str(tmp_path / "first")
    feed.mkdir()
    parts = ([("a.com", 600), ("b.com", 601)], [("a.com", 5), ("c.com", 2000)], [("b.com", 9000), ("c.com", 1)])
    for i, part in enumerate(parts):
        (feed / f"{i}.json").write_text("\n".join(message([d], m) for d, m in part) + "\n")
        events = R.explode_hosts(C.stream_messages(spark, str(feed)))
        St.drain(St.first_sighting_writer(events, store, str(tmp_path / "p1")))
        St.drain(C.store_new_domains(events, str(tmp_path / "new"), str(tmp_path / "p2")))
    minutes = (F.unix_seconds("seen_at") - int(START.timestamp())) / 60
    found = spark.read.parquet(store).select("domain", minutes.alias("m")).collect()
    assert sorted((r["domain"], r["m"]) for r in found) == [("a.com", 600), ("b.com", 601), ("c.com", 2000)]
    kept = C.read_new_domains(spark, str(tmp_path / "new")).select("domain", minutes.alias("m")).collect()
    assert sorted((r["domain"], r["m"]) for r in kept) == [("a.com", 5), ("b.com", 601), ("c.com", 1)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([("a.com", "CA", START)], "domain string, issuer string, seen_at timestamp")
    store = C.new_domain_store(f"{tmp_path}/store")
    for _ in range(2):
        store.add(C.earliest_sighting(df), 0)
    assert C.read_new_domains(spark, f"{tmp_path}/store").count() == 1
