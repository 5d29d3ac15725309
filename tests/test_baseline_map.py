import datetime as dt
import math

import numpy as np
import pytest

from conftest import make_bars
from tickscope.operators import baseline_map as BM


def real_design(n, start=17000.0):
    """The module's 53 columns for n daily bars, written out with numpy."""
    days = np.arange(n) + start
    t = (days - days[0]) / (days[-1] - days[0])
    bends = [(np.quantile(days, p, method="inverted_cdf") - days[0]) / (days[-1] - days[0]) for p in BM.CP_PROBS]
    waves = [fn(2 * math.pi * i / period * days) for period, order in (BM.WEEKLY, BM.YEARLY) for i in range(1, order + 1) for fn in (np.sin, np.cos)]
    return np.column_stack([np.ones(n), t, *[np.maximum(t - b, 0) for b in bends], *waves])


@pytest.mark.parametrize("n,seed", [(2557, 0), (2557, 1), (700, 2), (120, 3), (60, 4)])
def test_solution_satisfies_kkt_on_the_real_design(n, seed):
    rng = np.random.default_rng(seed)
    x = real_design(n)
    y = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    y /= np.abs(y).max()
    g, b = x.T @ x, x.T @ y
    beta, sigma, kkt = BM.solve_map(g, b, float(y @ y), float(n))
    l2, l1 = BM._penalties(BM.N_COLS)
    grad = x.T @ (x @ beta - y) / sigma ** 2 + l2 * beta          # gradient of the smooth part
    for i in range(BM.N_COLS):
        if l1[i] > 0 and beta[i] == 0:
            assert abs(grad[i]) <= l1[i] + 1e-4            # sub-gradient contains 0
        else:
            assert grad[i] + l1[i] * np.sign(beta[i]) == pytest.approx(0.0, abs=1e-4)
    assert kkt <= BM.TOLERANCE
    assert sigma == pytest.approx(math.sqrt(float(np.sum((y - x @ beta) ** 2)) / n), rel=1e-5)


def test_no_better_point_nearby():
    rng = np.random.default_rng(9)
    n = 900
    x = real_design(n)
    y = np.cumsum(rng.normal(0, 0.01, n)) + 1
    y /= np.abs(y).max()
    beta, sigma, _ = BM.solve_map(x.T @ x, x.T @ y, float(y @ y), float(n))
    l2, l1 = BM._penalties(BM.N_COLS)

    def objective(b):
        return ((y - x @ b) ** 2).sum() / (2 * sigma ** 2) + (l2 * b * b).sum() / 2 + (l1 * np.abs(b)).sum()
    best = objective(beta)
    assert all(objective(beta + rng.normal(0, scale, BM.N_COLS) * (rng.random(BM.N_COLS) < 0.2)) >= best - 1e-9 for scale in (1e-1, 1e-3, 1e-5) for _ in range(300))


def test_stored_coefficients_score_alike_in_sql(spark):
    """The model table re-scored in DuckDB: y from 53 coefficients and the SQL design, the band from sigma."""
    import os
    import tempfile

    import duckdb

    from conftest import SF_SMALL
    from tickscope.plans import oracle as O
    from tickscope.plans.fixtures import daily_bars
    bars = daily_bars(spark, SF_SMALL)
    model = BM.fit_map(bars).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="tickscope-map-"), "m")
    model.write.parquet(path)
    got = BM.score_map(bars, model).select("ticker", "Date", "yhat", "yhat_lower").toPandas().sort_values(["ticker", "Date"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF_SMALL}/lineitem.parquet'")
    design = O.design()
    design[1] = design[1].replace("SELECT ticker, list_concat", 'SELECT ticker, "Date", list_concat')
    want = con.execute(O.with_([*O.bars_daily(), *design], f"""
SELECT ticker, "Date", list_dot_product(z[:53], beta) * m.y_scale AS yhat, (list_dot_product(z[:53], beta) - 1.959963984540054 * sigma) * m.y_scale AS low
FROM dz JOIN '{path}/*.parquet' m USING (ticker) ORDER BY ticker, "Date" """)).df()
    np.testing.assert_allclose(got.yhat.to_numpy(), want.yhat.to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got.yhat_lower.to_numpy(), want.low.to_numpy(), rtol=1e-9)


def test_recovers_slope_and_weekly_wave(spark):
    base = dt.date(2018, 1, 1)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3 * 365):
        d = base + dt.timedelta(days=i)
        y = 100 + 0.05 * i + 2.0 * math.sin(2 * math.pi * i / 7.0) + rng.normal(0, 0.3)
        rows.append(("W", d.isoformat(), y, y, y, y, 1.0))
    bars = make_bars(spark, rows)
    out = BM.baseline_map(bars).toPandas().sort_values("Date")
    resid = out["Close"] - out["yhat"]
    assert resid.std() < 0.6                                  # trend + wave explained
    cover = ((out.Close >= out.yhat_lower) & (out.Close <= out.yhat_upper)).mean()
    assert 0.9 < cover < 0.99
    slope = np.polyfit(np.arange(len(out)), out["yhat"].to_numpy(), 1)[0]
    assert slope == pytest.approx(0.05, rel=0.05)


def test_all_zero_series_does_not_fail(spark):
    rows = [("Z", (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat(), 0.0, 0.0, 0.0, 0.0, 1.0)
            for i in range(60)]
    out = BM.baseline_map(make_bars(spark, rows)).toPandas()
    assert len(out) == 60 and (out.yhat.abs() < 1e-12).all() and (out.band_anomaly == 0).all()
