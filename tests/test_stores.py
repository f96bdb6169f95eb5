"""Stores that batches add to, late events, and what a batch reads of the past."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticegrade.operators import backtest as B
from noticegrade.operators import radar as R
from noticegrade.sources import certificates as C
from noticegrade.streaming import radar as St
from noticegrade.streaming.store import DailyStore, MergedStore, listed

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def merge(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def batch(spark, i, width=3):
    return spark.createDataFrame([(k, 1, i) for k in range(i, i + width)], "k long, n long, last long")


def totals(df):
    return {r["k"]: (r["n"], r["last"]) for r in df.collect()}


def expected(n, width=3):
    out = {}
    for i in range(n):
        for k in range(i, i + width):
            out[k] = (out.get(k, (0,))[0] + 1, i)
    return out


def test_merged_store_compacts_and_stays_right(spark, tmp_path):
    store = MergedStore(str(tmp_path / "s"), merge, least_batches=3, share=0.0)
    for i in range(11):
        store.add(batch(spark, i), i)
        assert totals(store.read(spark)) == expected(i + 1)
    snapshot, log = store.parts(spark)
    # snapshots after batches 2, 5 and 8; the last two are kept, and the batches since the older
    assert snapshot.endswith("upto=8") and [p.rsplit("=")[-1] for p in log] == ["9", "10"]
    assert sorted(listed(spark, f"{store.path}/snapshot", "upto")) == ["5", "8"]
    assert sorted(map(int, listed(spark, f"{store.path}/log", "batch"))) == [6, 7, 8, 9, 10]
    assert totals(store.read(spark, upto=7)) == expected(8)


def test_repeated_and_unfinished_batches(spark, tmp_path):
    store = MergedStore(str(tmp_path / "s"), merge, least_batches=2, share=0.0)
    for i in (0, 1, 1, 2, 3, 3, 3, 4):  # after a failure a batch comes again, also one that made a snapshot
        store.add(batch(spark, i), i)
    assert totals(store.read(spark)) == expected(5)
    batch(spark, 5).write.parquet(f"{store.path}/log/batch=5")
    Path(f"{store.path}/log/batch=5/_SUCCESS").unlink()  # its writer died
    assert totals(store.read(spark)) == expected(5)
    store.add(batch(spark, 5), 5)
    assert totals(store.read(spark)) == expected(6)


def test_large_snapshots_wait_for_a_share(spark, tmp_path):
    store = MergedStore(str(tmp_path / "s"), merge, least_batches=1, share=100.0)
    for i in range(4):
        store.add(batch(spark, i), i)
    assert store.parts(spark)[0].endswith("upto=0") and len(store.parts(spark)[1]) == 3


def test_daily_store_opens_the_days_asked_for(spark, tmp_path):
    store = DailyStore(str(tmp_path / "d"), "window_start")
    rows = lambda days: spark.createDataFrame([(START + dt.timedelta(days=d), "s", d) for d in days], St.COUNTS)
    for i, days in enumerate(([0, 1], [1, 2], [1, 2], [5])):
        store.add(rows(days), min(i, 2) if i != 2 else 1)  # batch 1 comes twice
    days = [START.date() + dt.timedelta(days=k) for k in (1, 2, 3)]
    found = store.read(spark, St.COUNTS, days)
    assert sorted((r["n"], r["batch"]) for r in found.collect()) == [(1, 0), (1, 1), (2, 1)]
    assert {Path(f).parent.parent.name for f in found.inputFiles()} == {"day=2024-01-02", "day=2024-01-03"}
    assert store.read(spark, St.COUNTS, days, upto=0).count() == 1
    store.forget(spark, days[1])
    assert sorted(listed(spark, store.path, "day")) == ["2024-01-03", "2024-01-06"]
    assert store.read(spark, St.COUNTS, [dt.date(1999, 1, 1)]).columns == ["window_start", "signature", "n", "batch"]


def message(host, minutes):
    seen = (START + dt.timedelta(minutes=minutes)).timestamp()
    return json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": [host], "issuer": {"O": "CA"}}, "seen": seen}})


def play(spark, feed, part, i, writers):
    feed.mkdir(exist_ok=True)
    (feed / f"{i}.json").write_text("\n".join(message(d, m) for d, m in part) + "\n")
    for make in writers:
        St.drain(make(R.explode_hosts(C.stream_messages(spark, str(feed)))))


def test_no_event_is_too_late(spark, tmp_path):
    base = str(tmp_path / "w")
    parts = (
        [("live1.xyz", 1), ("live2.xyz", 2), ("shop.com", 3)],
        [("live3.xyz", 14), ("live4.xyz", 60)],  # window 0 is still open: nothing ten minutes past its end
        [("live5.xyz", 5), ("live6.xyz", 61), ("shop.com", 4)],  # late
        [("live7.xyz", 0), ("live8.xyz", 3000)],
        [("shop2.com", 2990)],  # in its window's time
    )
    for i, part in enumerate(parts):
        play(spark, tmp_path / "feed", part, i, [lambda e: St.window_writer(e, base, str(tmp_path / "c"))])
    batch = R.window_counts(R.explode_hosts(C.read_messages(spark, str(tmp_path / "feed"))))
    same = lambda df: sorted(map(tuple, df.select("window_start", "signature", "n").collect()))
    assert same(St.read_window_counts(spark, base)) == same(batch)
    late = spark.read.parquet(f"{base}/late").select("domain", "batch").collect()
    assert sorted(map(tuple, late)) == [("live5.xyz", 2), ("live7.xyz", 3), ("shop.com", 2)]
    fixed = spark.read.parquet(f"{base}/corrections").select("batch", "signature", "n_late", "n").collect()
    assert sorted(map(tuple, fixed)) == [(2, "live|xyz", 1, 4), (2, "|com", 1, 2), (3, "live|xyz", 1, 5)]


def test_bursts_open_two_days_and_old_counts_go(spark, tmp_path):
    counts, alerts = str(tmp_path / "counts"), str(tmp_path / "alerts")
    writer = lambda e: St.burst_writer(St.closed_windows(e), counts, alerts, str(tmp_path / "c"), keep_days=1)
    day = 24 * 60
    for i in range(6):
        part = [("live.xyz", i * day + 60 * k) for k in range(24)] + [(f"live{k}.xyz", i * day + 600) for k in range(20 * (i == 4))]
        play(spark, tmp_path / "feed", part, i, [writer])
    left = sorted(listed(spark, counts, "day"))
    assert left[-1] == "2024-01-06" and len(left) <= 5 and "2024-01-01" not in left
    flagged = spark.read.parquet(alerts).select("signature", "n").collect()
    assert [tuple(r) for r in flagged] == [("live|xyz", 21)]


@pytest.mark.parametrize("on_disk", [False, True])
def test_first_sightings_survive_restarts(spark, tmp_path, on_disk):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if on_disk:
        St.state_on_disk(spark)
    try:
        store = str(tmp_path / "s")
        parts = ([("a.com", 9), ("a.com", 3), ("b.com", 4)], [("a.com", 1), ("c.com", 8)], [("b.com", 5)], [("d.com", 2), ("c.com", 1), ("d.com", 1)])
        for i, part in enumerate(parts):
            play(spark, tmp_path / "feed", part, i, [lambda e: St.first_sighting_writer(e, store, str(tmp_path / "c"))])
    finally:
        spark.conf.set(key, before)
    minutes = (F.unix_seconds("seen_at") - int(START.timestamp())) / 60
    got = spark.read.parquet(store).select("domain", minutes.cast("int").alias("m"), "batch").collect()
    assert sorted(map(tuple, got)) == [("a.com", 3, 0), ("b.com", 4, 0), ("c.com", 8, 1), ("d.com", 1, 3)]


def test_leads_as_of_the_takedown(spark):
    at = lambda day, hour=12: dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)
    seen = [("a", at(2)), ("a", at(5)), ("a", at(5, 20)), ("a", at(9)), ("b", at(9)), ("c", at(1)), ("d", at(4))]
    taken = [("a", 7), ("a", 8), ("b", 7), ("d", 4), ("e", 1)]
    got = B.feed_leads(
        spark.createDataFrame(seen, "domain string, seen_at timestamp"),
        spark.createDataFrame([(d, dt.date(2024, 1, k)) for d, k in taken], "domain string, date date"),
    )
    day = lambda k: dt.date(2024, 1, k)
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("a", day(2), day(7), 5, 3, day(5)), ("b", day(9), day(7), -2, 0, None), ("d", day(4), day(4), 0, 0, None)
    ]
