import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_bars, series
from tickscope.operators import baseline as bl
from tickscope.operators import iforest
from tickscope.operators.detect import DetectParams, detect
from tickscope.operators.quantile import quantile_by_key


def walk(n, seed=1, sigma=0.01):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0, sigma, n))))


@pytest.fixture(scope="module")
def toy_results(spark):
    closes = walk(300, 7)
    closes[200] = closes[199] * 1.6          # planted spike
    vols = [1000.0 + (i * 37) % 101 for i in range(300)]
    vols[200] = 50000.0
    rows = series("SPIKE", closes, vols) + series("CALM", walk(260, 8))
    return detect(make_bars(spark, rows), DetectParams(n_trees=60)).toPandas()


def test_planted_spike_scores_lowest(toy_results):
    t = toy_results[toy_results.ticker == "SPIKE"].sort_values("if_score")
    assert str(t.iloc[0]["Date"])[:10] == "2020-07-19"       # bar 200
    assert ((t.if_score > -1) & (t.if_score < 0)).all()


def test_flag_count_is_quantile_rank(toy_results):
    for _t, g in toy_results.groupby("ticker"):
        n = len(g)
        assert g.if_anomaly.sum() == int(np.floor(0.02 * (n - 1))) + 1
        assert (g.consensus_anomaly <= np.minimum(g.if_anomaly, g.band_anomaly)).all()


def test_forest_is_deterministic(spark):
    rows = series("D", walk(120, 3))
    bars = make_bars(spark, rows)
    a = detect(bars, DetectParams(n_trees=20)).select("Date", "if_score").toPandas()
    b = detect(bars, DetectParams(n_trees=20)).select("Date", "if_score").toPandas()
    pd.testing.assert_frame_equal(a.sort_values("Date").reset_index(drop=True),
                                  b.sort_values("Date").reset_index(drop=True))


def test_other_tickers_do_not_change_a_ticker(spark):
    one = make_bars(spark, series("A", walk(150, 11)))
    two = make_bars(spark, series("A", walk(150, 11)) + series("B", walk(150, 12)))
    a = detect(one, DetectParams(n_trees=20)).select("Date", "if_score").toPandas()
    b = detect(two, DetectParams(n_trees=20)).filter(F.col("ticker") == "A").select("Date", "if_score").toPandas()
    np.testing.assert_allclose(a.sort_values("Date").if_score.to_numpy(),
                               b.sort_values("Date").if_score.to_numpy())


def test_tree_arrays_walk_matches_leaves():
    x = np.random.default_rng(0).normal(size=(256, 10))
    f, v, hb, ns, nl = iforest._grow_tree(x, "T", 0, 8, 42)
    assert nl == ns + 1
    # every row reaches a bottom slot that carries a path length
    for row in x:
        nd = 0
        for _ in range(iforest.MAX_DEPTH):
            nd = 2 * nd + 1 + int(row[f[nd]] > v[nd])
        assert hb[nd - iforest.INNER_SLOTS] > 0


def test_quantile_matches_pandas(spark):
    rng = np.random.default_rng(5)
    vals = [("a", float(v)) for v in rng.uniform(-0.9, -0.1, 997)] + \
           [("b", float(v)) for v in rng.uniform(-0.7, -0.3, 51)] + [("c", -0.5)] + [("tied", -0.4)] * 500
    df = spark.createDataFrame(vals, "ticker string, s double")
    got = {r[0]: r[1] for r in quantile_by_key(df, "s", 0.02).collect()}
    pdf = pd.DataFrame(vals, columns=["ticker", "s"])
    for t, g in pdf.groupby("ticker"):
        assert got[t] == pytest.approx(g.s.quantile(0.02), abs=1e-15)


def test_baseline_recovers_slope_and_weekly_wave(spark):
    import datetime as dt
    base = dt.date(2019, 1, 1)
    rows = []
    for i in range(700):
        d = base + dt.timedelta(days=i)
        y = 50 + 0.1 * i + 3.0 * (d.weekday() == 0)
        rows.append(("W", d.isoformat(), y, y, y, y, 100.0))
    bars = make_bars(spark, rows)
    trend, weekly, _yearly = bl.fit_decompose(bars)
    assert trend.first()["slope"] == pytest.approx(0.1, rel=1e-3)
    w = {r["dow"]: r["weekly"] for r in weekly.collect()}
    assert w[2] - w[3] == pytest.approx(3.0, abs=0.05)       # Monday (Spark dow 2) vs Tuesday
    scored = bl.baseline(bars).toPandas()
    assert scored.band_anomaly.mean() < 0.1


def test_detect_same_in_chunked_mode(spark, monkeypatch):
    """Force the skew-safe plan (time chunks + halo fix-up, histogram quantile) and
    compare with the plain plan: identical results."""
    from tickscope.operators import windows
    rows = series("A", walk(260, 21)) + series("B", walk(180, 22))
    bars = make_bars(spark, rows)
    p = DetectParams(n_trees=30)
    plain = detect(bars, p).toPandas().sort_values(["ticker", "Date"]).reset_index(drop=True)
    monkeypatch.setattr(windows, "TARGET_ROWS_PER_TASK", 40)
    windows._STATS_MEMO.clear()
    assert windows.series_stats(bars).chunked
    chunked = detect(bars, p).toPandas().sort_values(["ticker", "Date"]).reset_index(drop=True)
    windows._STATS_MEMO.clear()
    assert len(plain) == len(chunked)
    for c in ["volatility_20d", "ma_50", "if_score", "yhat"]:
        np.testing.assert_allclose(plain[c].to_numpy(), chunked[c].to_numpy(), rtol=1e-9, atol=1e-12)
    for c in ["if_anomaly", "band_anomaly", "consensus_anomaly"]:
        assert (plain[c] == chunked[c]).all()


def test_single_feature_row_ticker_does_not_fail(spark):
    rows = series("ONE", walk(50, 31)) + series("MANY", walk(200, 32))
    out = detect(make_bars(spark, rows), DetectParams(n_trees=10)).toPandas()
    one = out[out.ticker == "ONE"]
    assert len(one) == 1 and one.if_score.isna().all() and (one.if_anomaly == 0).all()
    many = out[out.ticker == "MANY"]
    assert many.if_score.notna().all() and many.if_anomaly.sum() == int(np.floor(0.02 * 150)) + 1


def test_reference_column_names(spark):
    from tickscope.operators.detect import RESULT_COLS, with_reference_names
    df = spark.createDataFrame([tuple([None] * len(RESULT_COLS))],
                               ", ".join(f"`{c}` string" for c in RESULT_COLS))
    cols = with_reference_names(df).columns
    assert "prophet_anomaly" in cols and "band_anomaly" not in cols and len(cols) == len(RESULT_COLS)


def test_no_ticker_left_is_an_error(spark):
    vols = [1000.0 + (i * 37) % 101 for i in range(80)]
    vols[60] = 0.0
    with pytest.raises(ValueError, match="no ticker"):
        detect(make_bars(spark, series("Z", walk(80), vols)), DetectParams(n_trees=5, baseline="decompose"))
    rows = detect(make_bars(spark, series("Z", walk(80), vols)), DetectParams(n_trees=5, baseline="decompose", on_bad="drop_rows"))
    assert rows.count() == 30


def test_scoring_keeps_every_row_and_equals_any_block_size(spark, monkeypatch):
    from tickscope.operators.features import build_features
    from tickscope.operators.scaler import apply_scaler, fit_scaler
    bars = make_bars(spark, series("A", walk(160, 1)) + series("B", walk(120, 2)))
    feat = build_features(bars)
    scaled = apply_scaler(feat, fit_scaler(feat)).checkpoint()
    forest = iforest.fit_forest(scaled, 15)
    # a repeated (ticker, Date) with other values stays a row of its own
    twice = scaled.unionByName(scaled.filter("ticker = 'A'").limit(1).withColumn("x", F.transform("x", lambda v: v + 3)))
    one = iforest.score(twice, forest, keep=["Close"]).toPandas().sort_values(["ticker", "Date", "if_score"]).reset_index(drop=True)
    monkeypatch.setattr(iforest, "BLOCK_ROWS", 17)
    many = iforest.score(twice, forest, keep=["Close"]).toPandas().sort_values(["ticker", "Date", "if_score"]).reset_index(drop=True)
    assert len(one) == scaled.count() + 1
    pd.testing.assert_frame_equal(one, many)


def test_trees_that_fall_short_are_redone(spark, monkeypatch):
    from tickscope.operators.features import build_features
    from tickscope.operators.scaler import apply_scaler, fit_scaler
    feat = build_features(make_bars(spark, series("A", walk(900, 3)) + series("B", walk(90, 4))))
    scaled = apply_scaler(feat, fit_scaler(feat)).checkpoint()
    cols = ["ticker", "t", "n_rows", "n_splits", "f", "v"]

    def forest():
        return iforest.fit_forest(scaled, 30, 64).select(*cols).toPandas().sort_values(["ticker", "t"]).reset_index(drop=True)
    want = forest()
    monkeypatch.setattr(iforest, "SLACK", -1.0)      # most trees get too few candidates
    got = forest()
    assert set(got.n_rows) == {64, 41} and len(got) == 60
    assert all(np.array_equal(a, b) for c in ("f", "v") for a, b in zip(got[c], want[c])) and (got.n_splits == want.n_splits).all()


def test_tree_keys_are_not_linearly_tied(spark):
    """key(t) - 2 key(t+1) + key(t+2) differs from row to row, and keys of sub-second bars differ."""
    import datetime as dt
    base = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("A", base + dt.timedelta(milliseconds=100 * i), [0.0] * 10) for i in range(400)], "ticker string, Date timestamp_ntz, x array<double>")
    keyed = iforest._keyed(df, iforest.all_trees(iforest.series_sizes(df), 12, 42), 42, 1)
    wide = keyed.groupBy("rk").pivot("t", list(range(12))).agg(F.first("u")).toPandas().drop(columns="rk").to_numpy()
    assert len(wide) == 400
    second = (wide[:, :-2] - 2 * wide[:, 1:-1] + wide[:, 2:]) % 1
    assert min(len(np.unique(np.round(second[:, k], 9))) for k in range(second.shape[1])) > 390
    assert np.abs(np.corrcoef(wide.T) - np.eye(12)).max() < 0.2 and abs(wide.mean() - 0.5) < 0.03


def test_trees_of_larger_samples_are_deeper(spark):
    from tickscope.operators import iforest
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1024, 3))
    for psi, depth in ((256, 8), (257, 9), (1024, 10)):
        f, v, hb, n_splits, n_leaves = iforest._grow_tree(x[:psi], "A", 0, depth, 42, psi)
        assert len(f) == len(v) == 2 ** depth - 1 and len(hb) == 2 ** depth and n_leaves == n_splits + 1
        assert psi == 256 or np.isfinite(v[255:]).any()
        # the walk ends where a plain descent does, a leaf's path being its depth and c of its rows
        def descend(node, level, idx):
            if np.isinf(v[node]) if node < len(v) else True:
                return {i: level + iforest.avg_path_length_py(len(idx)) for i in idx}
            left = [i for i in idx if x[i, f[node]] <= v[node]]
            return descend(2 * node + 1, level + 1, left) | descend(2 * node + 2, level + 1, [i for i in idx if i not in set(left)])
        want = descend(0, 0, list(range(psi)))
        got = iforest.walk(x[:psi], f[None], v[None], hb[None])
        np.testing.assert_allclose(got, [want[i] for i in range(psi)])
    with pytest.raises(ValueError):
        iforest.series_sizes(spark.createDataFrame([("A",)], "ticker string"), 2 ** 17)


def test_broadcast_bound_counts_what_arrays_hold(spark):
    from tickscope.operators import iforest, joins
    sizes = spark.createDataFrame([("A", 10, 10, 4)], "ticker string, n long, psi long, depth_limit int")
    trees = iforest.all_trees(sizes, 300, 42)
    assert joins.row_width(trees.schema, 300) > 300 * 24


def test_recent_window_reaches_the_scan(spark):
    import tempfile
    from conftest import make_bars, series
    from tickscope.operators.live import recent_window
    out = tempfile.mkdtemp() + "/bars"
    make_bars(spark, series("A", [100.0 + i for i in range(200)])).write.parquet(out)
    recent = recent_window(spark.read.parquet(out), lookback_days=30)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Date" in plan and recent.count() == 30


def test_unconverged_tickers_have_no_band(spark):
    from conftest import make_bars, series
    from tickscope.operators import baseline_map as bm
    from pyspark.sql import functions as F
    bars = make_bars(spark, series("A", [100.0 + i % 9 for i in range(120)]) + series("B", [50.0 + i % 5 for i in range(120)]))
    model = bm.fit_map(bars).withColumn("converged", F.col("ticker") == "A").checkpoint()
    got = {r["ticker"]: r for r in bm.score_map(bars, model).groupBy("ticker").agg(F.count("yhat_upper").alias("n"), F.max("band_anomaly").alias("m"), F.count("band_anomaly").alias("k")).collect()}
    assert got["A"]["n"] == 120 and got["B"]["n"] == 0 and got["B"]["m"] == 0 and got["B"]["k"] == 120
