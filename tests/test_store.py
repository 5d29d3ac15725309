"""The stream's store: atomic batches, replays, merging of runs, and reads that don't grow with the stream."""

import datetime as dt
import os
import tempfile

import pytest

from conftest import make_bars, series
from tickscope.schemas import BARS_SCHEMA
from tickscope.streaming import live_stream as live
from tickscope.streaming.store import RunStore, newest

SCHEMA = "k long, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(store):
    return sorted((r["k"], r["v"]) for r in newest(store.read("t", SCHEMA), ["k"]).collect())


def test_a_batch_takes_effect_at_once_or_not_at_all(spark):
    store = RunStore(spark, tempfile.mkdtemp(prefix="tickscope-store-"))
    assert store.state()["batch"] == -1 and content(store) == []
    store.publish(0, {"t": store.write("t", rows(spark, (1, 10), (2, 20)), 0), "u": store.write("u", rows(spark, (1, 1)), 0)})
    store.write("t", rows(spark, (1, 11)), 1)                    # killed before its pointer
    again = RunStore(spark, store.folder)
    assert content(again) == [(1, 10), (2, 20)] and again.state()["batch"] == 0
    again.publish(1, {"t": again.write("t", rows(spark, (1, 12)), 1), "u": None})
    assert content(again) == [(1, 12), (2, 20)]
    assert again.vacuum() == 1 and content(again) == [(1, 12), (2, 20)]


def test_two_writers_are_noticed(spark, monkeypatch):
    store = RunStore(spark, tempfile.mkdtemp(prefix="tickscope-store-"))
    old = store.state()
    store.publish(0, {})
    monkeypatch.setattr(store, "state", lambda: old)
    with pytest.raises(RuntimeError, match="two writers"):
        store.publish(0, {})


def test_runs_are_merged_by_size_and_the_newest_row_stays(spark):
    store, want = RunStore(spark, tempfile.mkdtemp(prefix="tickscope-store-"), fan=3), {}
    for b in range(11):
        part = [(b % 4, b), (100 + b, b)]
        want.update(part)
        store.publish(b, {"t": store.write("t", rows(spark, *part), b)})
        store.compact("t", SCHEMA, ["k"])
        assert content(store) == sorted(want.items())
    levels = [r["level"] for r in store.state()["tables"]["t"]]
    assert sorted(levels) == [0, 0, 2] and len(os.listdir(os.path.join(store.folder, "_versions"))) <= 2 * 3
    assert store.vacuum() > 5 and content(store) == sorted(want.items())


def test_a_range_opens_only_the_runs_it_touches(spark):
    store = RunStore(spark, tempfile.mkdtemp(prefix="tickscope-store-"))
    for b in range(4):
        store.publish(b, {"bars": store.write("bars", make_bars(spark, series("A", [100.0 + i for i in range(10)], start=f"2020-0{b + 1}-01")), b)})
    got = store.read("bars", BARS_SCHEMA, dt.datetime(2020, 2, 5), dt.datetime(2020, 3, 2))
    assert got.count() == 6 + 2 and len(got.inputFiles()) < len(store.read("bars", BARS_SCHEMA).inputFiles())
    assert store.extent("bars") == (dt.datetime(2020, 1, 1), dt.datetime(2020, 4, 10))


def test_what_a_batch_reads_does_not_grow_with_the_stream(spark, monkeypatch):
    """50 batches: each reads about as many bytes as the tenth, and a late bar reads a range of time."""
    store = RunStore(spark, tempfile.mkdtemp(prefix="tickscope-store-"), fan=4)
    bars = series("A", [100 + i % 13 for i in range(1100)]) + series("B", [50 + i % 7 for i in range(1100)])
    read, real = [], RunStore.read_runs
    monkeypatch.setattr(live, "score_batch", lambda batch, known, *_: batch.join(known.groupBy("ticker").count(), "ticker", "left")
                        .selectExpr("ticker", "Date", "Close", "double(count) if_score", "0D threshold", "0 if_anomaly", "0D daily_return", "0D volume_zscore"))
    monkeypatch.setattr(RunStore, "compact", lambda self, table, schema, keys, whole=False, real=RunStore.compact: whole and real(self, table, schema, keys, whole))

    def counting(self, runs, schema, *cut):
        read.extend(os.path.getsize(os.path.join(self.folder, r["path"], f)) for r in runs for f in os.listdir(os.path.join(self.folder, r["path"])) if f.endswith(".parquet"))
        return real(self, runs, schema, *cut)
    monkeypatch.setattr(RunStore, "read_runs", counting)
    cost = []
    for b in range(50):
        read.clear()
        live.apply_batch(store, make_bars(spark, [r for t in (0, 1100) for r in bars[t + 20 * b:t + 20 * b + 20]]), b, None, None, None)
        cost.append(sum(read))
    assert max(cost[10:]) < 1.5 * max(cost[6:10])
    tails = {r["ticker"]: r for r in newest(store.read("tail", live.TAIL_SCHEMA), ["ticker"]).collect()}
    assert all(len(r["bars"]) == live.TAIL and r["cut"] and r["bars"][-1]["Date"] == dt.datetime(2020, 1, 1) + dt.timedelta(days=999) for r in tails.values())
    # replaying adds nothing
    state = store.state()
    assert live.apply_batch(store, make_bars(spark, bars[:20]), 49, None, None, None) is None and store.state() == state
    read.clear()
    late = live.around(store, make_bars(spark, [bars[400]]), days=64)
    dates = [r["Date"] for r in late.select("Date").collect()]
    whole = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(store.folder, "bars")) for f in fs if f.endswith(".parquet"))
    assert len(dates) == 129 and sum(read) < whole / 4
