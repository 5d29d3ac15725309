import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickscope.operators import alerts as A
from tickscope.operators import portfolio as P

RES_SCHEMA = ("ticker string, Date timestamp_ntz, Close double, if_score double, if_anomaly int, "
              "band_anomaly int, consensus_anomaly int, residual double, daily_return double, volume_zscore double")


def res(spark, rows):
    out = []
    for t, d, c, s, fi, fb, fc in rows:
        out.append((t, dt.datetime.fromisoformat(d), float(c), float(s), fi, fb, fc, -1.0, 0.01, 0.5))
    return spark.createDataFrame(out, RES_SCHEMA)


def test_most_flagged_tie_is_alphabetical(spark):
    r = res(spark, [("B", "2020-01-01", 1, -0.5, 1, 1, 1), ("A", "2020-01-01", 1, -0.5, 1, 1, 1)])
    assert P.most_flagged(r).first()[0] == "A"


def test_most_flagged_none(spark):
    r = res(spark, [("B", "2020-01-01", 1, -0.5, 0, 1, 0)])
    assert P.most_flagged(r).first()[0] == "—"


def test_heatmap_zero_and_missing(spark):
    r = res(spark, [("A", "2020-01-05", 1, -0.5, 1, 1, 1), ("B", "2020-02-05", 1, -0.5, 0, 0, 0)])
    h = {(x.ticker, x.month): x.consensus_count for x in P.heatmap(r, ["A", "B", "X"]).collect()}
    assert h[("A", "2020-01")] == 1 and h[("A", "2020-02")] == 0
    assert h[("B", "2020-01")] == 0
    assert h[("X", "2020-01")] is None


def test_corr_symmetric_unit_diagonal(spark):
    rows = []
    for i in range(30):
        d = (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat()
        rows += [("A", d, 1, -0.5 + 0.01 * i, 0, 0, 0), ("B", d, 1, -0.4 + 0.02 * i, 0, 0, 0),
                 ("C", d, 1, -0.4 - 0.01 * (i % 7), 0, 0, 0)]
    c = {(x.a, x.b): x.corr for x in P.score_corr(res(spark, rows), ["A", "B", "C"]).collect()}
    assert c[("A", "B")] == pytest.approx(1.0)
    assert c[("A", "C")] == c[("C", "A")]
    assert all(c[(t, t)] == 1.0 for t in "ABC")


def test_corr_needs_two_tickers_and_common_dates(spark):
    r = res(spark, [("A", "2020-01-01", 1, -0.5, 0, 0, 0), ("B", "2020-01-02", 1, -0.5, 0, 0, 0)])
    assert P.score_corr(r, ["A"]).count() == 0
    assert P.score_corr(r, ["A", "B"]).count() == 0


def test_alert_cutoff_and_modes(spark):
    r = res(spark, [("A", "2024-05-09", 10, -0.7, 1, 1, 1), ("A", "2024-05-10", 11, -0.7, 1, 1, 1),
                    ("B", "2024-05-08", 12, -0.7, 1, 1, 1)])
    saved = A.alerts_saved(r, "2024-05-10", 1).collect()
    assert sorted(str(x.Date)[:10] for x in saved) == ["2024-05-09", "2024-05-10"]
    live = spark.createDataFrame([("C", dt.datetime(2024, 5, 10), 5.0, -0.8, -0.6, True, 0.0, 0.0)],
                                 "ticker string, date timestamp_ntz, close double, if_score double, "
                                 "threshold double, anomaly boolean, daily_ret double, vol_z double")
    fresh = A.alerts_auto(r, live, "2024-05-10", 1).collect()
    assert {x.source for x in fresh} == {"consensus"}
    stale = A.alerts_auto(r, live, "2024-06-30", 1).collect()
    assert [(x.ticker, x.source, x.residual) for x in stale] == [("C", "live_IF_only", 0.0)]
    forced = A.alerts_auto(r, live, "2024-05-10", 1, force_live=True).collect()
    assert len(forced) == 1
    dig = A.alert_digest(A.alerts_saved(r, "2024-05-10", 1).unionByName(A.alerts_live(live))).first()
    assert (dig.n_tickers, dig.tag) == (2, "mixed")
    rows = A.alert_rows(A.alerts_live(live)).first()
    assert rows.direction == "Above trend" and rows.close_text == "$5.00"
    assert not A.anything_to_send(A.alerts_saved(r, "2025-01-01", 1))


def test_rolling_rate_null_until_full(spark):
    rows = [("A", (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat(), 1, -0.5, 1, 1, int(i % 10 == 0))
            for i in range(40)]
    out = P.rolling_rate(res(spark, rows)).orderBy("Date").toPandas()
    assert out.rolling_rate_pct[:29].isna().all()
    assert out.rolling_rate_pct[29] == pytest.approx(100 * 3 / 30)
    _ = F


def test_correlation_by_tiles_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    names = [f"T{i:02d}" for i in range(11)]
    z = rng.normal(size=(400, 11)) + rng.normal(size=(400, 1))
    z[:, 4] = -0.25
    rows = [(n, d, float(z[d, i])) for d in range(400) for i, n in enumerate(names) if not (d % 7 == 0 and i == 2)]
    long = P.complete_dates(spark.createDataFrame(rows, "ticker string, Date int, if_score double").repartition(5), names).checkpoint()
    kept = np.array([d for d in range(400) if d % 7])
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(z[kept].T)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for tile in (3, 11, 256):
            got = {(r.a, r.b): r.corr for r in P._pair_stats(long, names, tile).collect()}
            assert set(got) == {(a, b) for a in names for b in names if a < b}
            for (a, b), c in got.items():
                i, j = names.index(a), names.index(b)
                assert c is None if 4 in (i, j) else abs(c - want[i, j]) < 1e-12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_correlation_of_many_tickers_joins_no_scores_by_date(spark):
    from pyspark.sql import functions as F
    k, dates = 500, 10_000
    names = [f"T{i:03d}" for i in range(k)]
    frame = spark.range(k * dates).select(F.format_string("T%03d", F.col("id") % k).alias("ticker"), F.floor(F.col("id") / k).cast("int").alias("Date"),
                                          ((F.xxhash64("id") % 1000) / 1000.0 + F.when(F.col("id") % k < 2, (F.floor(F.col("id") / k) % 100) / 10.0).otherwise(0.0)).alias("if_score"))
    stats = P._pair_stats(frame, names)
    tree = stats._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in tree and "ShuffledHashJoin" not in tree and "Cartesian" not in tree and "NestedLoop" not in tree
    got = stats.agg(F.count("*").alias("n"), F.max(F.struct("corr", "a", "b")).alias("m"), F.avg(F.abs("corr")).alias("typical")).first()
    assert got.n == k * (k - 1) // 2 and (got.m.a, got.m.b) == ("T000", "T001") and got.m.corr > 0.9 and got.typical < 0.02
