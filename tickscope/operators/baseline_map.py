"""Trend-with-changepoints + Fourier seasonality baseline, MAP fit (method ``map``).

Model (the published additive forecasting model, library defaults): y / max|y| =
k*t + m + sum_j delta_j * max(0, t - s_j) + weekly(order 3, period 7 d) +
yearly(order 10, period 365.25 d) + noise; t = time scaled to [0, 1] per series;
25 changepoints s_j at the 0.8*j/25 quantiles of t (the first 80 % of the
history); priors k, m ~ N(0, 5), delta ~ Laplace(0.05), seasonal ~ N(0, 10).
Daily seasonality is off. 53 regression columns.

Spark plan
  1. per-series scalars (partial aggregate; changepoints from ``percentile_approx``);
  2. bars are range-partitioned by (ticker, time), so a partition holds few series and a long series is split;
     a design row is built with built-in expressions and a numpy helper (``mapInPandas``) adds up the upper triangle
     of Z'Z, Z = [X y], per series over the whole partition: one array per series and partition;
  3. ``posexplode`` + ``groupBy(ticker, pos).sum`` combines the pieces;
  4. per series one small solve (``applyInPandas``): for a fixed noise scale the terms without a Laplace prior
     are eliminated and the remaining 25-column lasso is solved exactly by feature-sign search (finitely many
     linear solves); the noise scale, RSS / n from the Gram matrix, is iterated to its fixed point. The
     largest violation of the optimality conditions is returned as ``kkt`` and ``converged`` says whether it is below TOLERANCE;
  5. scoring: a join of 53 coefficients and one codegen sum.
The 95 % band in history is yhat +/- 1.96 * sigma * max|y|: the closed form of the
library's Monte-Carlo in-sample interval (trend uncertainty is zero inside the
history). After the end of training the band widens by the variance of future trend changes, which the library samples: 25 per
unit of t, Laplace with scale mean |delta|, so 2 * 25 * scale^2 * (t - 1)^3 / 3.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INTERVAL_Z, KEY, TIME
from .joins import join_small

# Fixed values of the model (library defaults used by the reference configuration).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
TREND_PRIOR = 5.0
WEEKLY = (7.0, 3)
YEARLY = (365.25, 10)
N_COLS = 2 + N_CHANGEPOINTS + 2 * WEEKLY[1] + 2 * YEARLY[1]   # 53
DAY_MICROS = 86_400_000_000.0
CP_PROBS = [CHANGEPOINT_RANGE * j / N_CHANGEPOINTS for j in range(1, N_CHANGEPOINTS + 1)]


def _days(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) / F.lit(DAY_MICROS)


def series_scalars(bars: DataFrame) -> DataFrame:
    d = _days(F.col(TIME))
    return bars.groupBy(KEY).agg(
        F.min(d).alias("t0"), F.max(d).alias("t1"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs("Close")).alias("y_scale"),
        F.percentile_approx(d, CP_PROBS, 100000).alias("cp_days"))


def design(df: DataFrame) -> Column:
    """Array of the 53 regression columns for one row (needs t0, t1, cp_days)."""
    days = _days(F.col(TIME))
    span = F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0")).otherwise(F.lit(1.0))
    t = (days - F.col("t0")) / span
    cols = [F.lit(1.0), t]
    for j in range(N_CHANGEPOINTS):
        s = (F.get(F.col("cp_days"), j) - F.col("t0")) / span
        cols.append(F.greatest(t - s, F.lit(0.0)))
    for period, order in (WEEKLY, YEARLY):
        for i in range(1, order + 1):
            ang = F.lit(2.0 * math.pi * i / period) * days
            cols += [F.sin(ang), F.cos(ang)]
    return F.array(*cols)


GRAM_SCHEMA = "ticker string, vec array<double>"
#: Upper triangle of Z'Z, Z = [X y].
TRIANGLE = np.triu_indices(N_COLS + 1)
#: Series whose sums a task holds before it gives them out.
HELD_SERIES = 2000


def _gram_pieces(batches):
    held: dict[str, np.ndarray] = {}
    give = lambda: pd.DataFrame([(k, v.tolist()) for k, v in held.items()], columns=[KEY, "vec"])
    for pdf in batches:
        for ticker, g in pdf.groupby(KEY, sort=False):
            z = np.column_stack([np.stack(g["x"].to_numpy()), g["y"].to_numpy(dtype=float)])
            held[ticker] = held.get(ticker, 0.0) + (z.T @ z)[TRIANGLE]
        if len(held) >= HELD_SERIES:
            yield give()
            held.clear()
    if held:
        yield give()


def _penalties(n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-column Gaussian precision and Laplace weight."""
    l2 = np.zeros(n_cols)
    l1 = np.zeros(n_cols)
    l2[0] = l2[1] = 1.0 / TREND_PRIOR ** 2
    l1[2:2 + N_CHANGEPOINTS] = 1.0 / CHANGEPOINT_PRIOR
    l2[2 + N_CHANGEPOINTS:] = 1.0 / SEASONALITY_PRIOR ** 2
    return l2, l1


#: Largest violation of the optimality conditions that counts as solved (the Laplace weight is 20).
TOLERANCE = 1e-4


def feature_sign(s: np.ndarray, r: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact minimiser of x'Sx / 2 - r'x + sum w|x| from the start x: signs are guessed, the quadratic is solved for
    them, and the best point on the way (at a sign change or the end) is taken; each step lowers the objective."""
    value = lambda v: 0.5 * v @ s @ v - r @ v + w @ np.abs(v)
    x = x.copy()
    for _ in range(4000):
        grad = s @ x - r
        on = x != 0
        if on.any() and np.abs(grad + w * np.sign(x))[on].max() > 1e-3 * TOLERANCE:
            signs = np.sign(x)
        else:
            gap = np.where(on, 0.0, np.abs(grad) - w)
            new = int(gap.argmax())
            if gap[new] <= 1e-3 * TOLERANCE:
                return x
            signs = np.sign(x)
            signs[new] = -np.sign(grad[new])
        active = np.flatnonzero(signs)
        goal = np.zeros_like(x)
        goal[active] = np.linalg.lstsq(s[np.ix_(active, active)], r[active] - w[active] * signs[active], rcond=None)[0]
        step = goal - x
        turns = [t for t in (-x[i] / step[i] for i in active if step[i] != 0 and x[i] != 0) if 0 < t < 1]
        points = [goal]
        for t in turns:
            point = x + t * step
            point[np.abs(point) < 1e-14 * np.abs(x).max()] = 0.0
            points.append(point)
        best = min(points, key=value)
        if value(best) >= value(x) - 1e-15 * abs(value(x)):
            return best if value(best) < value(x) else x
        x = best
    return x


def kkt_residual(gram: np.ndarray, xty: np.ndarray, beta: np.ndarray, sigma2: float) -> float:
    l2, l1 = _penalties(len(xty))
    grad = (gram @ beta - xty) / sigma2 + l2 * beta
    at_zero = (beta == 0) & (l1 > 0)
    return float(np.where(at_zero, np.maximum(np.abs(grad) - l1, 0.0), np.abs(grad + l1 * np.sign(beta))).max())


def solve_map(gram: np.ndarray, xty: np.ndarray, yty: float, n: float, rounds: int = 1000) -> tuple[np.ndarray, float, float]:
    """min ||y - Xb||^2 / (2 s^2) + n log s + sum l2_i b_i^2 / 2 + sum l1_i |b_i|: (b, s, kkt residual)."""
    k = len(xty)
    l2, l1 = _penalties(k)
    d, u = np.flatnonzero(l1 > 0), np.flatnonzero(l1 == 0)
    beta = np.zeros(k)
    sigma2 = max(yty / max(n, 1.0), 1e-12)
    for _ in range(rounds):
        a = gram / sigma2 + np.diag(l2)
        c = xty / sigma2
        solved = np.linalg.solve(a[np.ix_(u, u)], np.column_stack([a[np.ix_(u, d)], c[u]]))
        schur = a[np.ix_(d, d)] - a[np.ix_(d, u)] @ solved[:, :-1]
        beta[d] = feature_sign((schur + schur.T) / 2, c[d] - a[np.ix_(d, u)] @ solved[:, -1], l1[d], beta[d])
        beta[u] = solved[:, -1] - solved[:, :-1] @ beta[d]
        rss = max(yty - 2.0 * beta @ xty + beta @ gram @ beta, 0.0)
        new = max(rss / max(n, 1.0), 1e-12)
        done = abs(new - sigma2) <= 1e-13 * sigma2
        sigma2 = new
        if done:
            break
    return beta, math.sqrt(sigma2), kkt_residual(gram, xty, beta, sigma2)


FIT_SCHEMA = "ticker string, beta array<double>, sigma double, kkt double, converged boolean"


def _solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
    z = np.zeros((N_COLS + 1, N_COLS + 1))
    values = np.zeros(len(TRIANGLE[0]))
    values[pdf["pos"].to_numpy()] = pdf["v"].to_numpy()
    z[TRIANGLE] = values
    z = z + np.triu(z, 1).T
    # the first column is 1, so the first entry counts the rows
    beta, sigma, kkt = solve_map(z[:-1, :-1], z[:-1, -1], z[-1, -1], z[0, 0])
    return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "beta": [beta.tolist()], "sigma": [sigma], "kkt": [kkt], "converged": [kkt <= TOLERANCE]})


def gram_sums(bars: DataFrame, scalars: DataFrame, n_series: int | None = None) -> DataFrame:
    """(ticker, pos, v): entry ``pos`` of the upper triangle of Z'Z, row by row."""
    rows = join_small(bars.select(KEY, TIME, "Close").repartitionByRange(KEY, TIME), scalars, KEY, n_series)
    y = F.coalesce(F.try_divide(F.col("Close"), F.col("y_scale")), F.lit(0.0))   # all-zero series
    xy = rows.select(KEY, design(rows).alias("x"), y.alias("y")).filter(F.col("x").isNotNull())
    pieces = xy.mapInPandas(_gram_pieces, GRAM_SCHEMA)
    return (pieces.select(KEY, F.posexplode("vec").alias("pos", "v"))
            .groupBy(KEY, "pos").agg(F.sum("v").alias("v")))


def fit_map(bars: DataFrame, n_series: int | None = None) -> DataFrame:
    """Model table (ticker, t0, t1, n, y_scale, cp_days, beta, sigma, kkt, converged)."""
    sc = series_scalars(bars)
    fitted = gram_sums(bars, sc, n_series).groupBy(KEY).applyInPandas(_solve_group, FIT_SCHEMA)
    return sc.join(fitted, KEY)


def score_map(bars: DataFrame, model: DataFrame, n_series: int | None = None,
              z: float = INTERVAL_Z) -> DataFrame:
    """Adds yhat, yhat_lower, yhat_upper, residual, band_anomaly. A ticker whose fit hasn't converged has no band and no flag."""
    j = join_small(bars, model.select(KEY, "t0", "t1", "y_scale", "cp_days", "beta", "sigma", "converged"),
                   KEY, n_series)
    j = j.withColumn("_x", design(j))
    fx = sum((F.get(F.col("_x"), i) * F.get(F.col("beta"), i) for i in range(N_COLS)), F.lit(0.0))
    j = j.withColumn("yhat", fx * F.col("y_scale"))
    span = F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0")).otherwise(F.lit(1.0))
    after = F.greatest((_days(F.col(TIME)) - F.col("t1")) / span, F.lit(0.0))
    change = F.aggregate(F.slice("beta", 3, N_CHANGEPOINTS), F.lit(0.0), lambda acc, b: acc + F.abs(b)) / F.lit(float(N_CHANGEPOINTS))
    spread = F.sqrt(F.col("sigma") * F.col("sigma") + F.lit(2.0 * N_CHANGEPOINTS / 3.0) * change * change * after * after * after)
    half = F.when(F.col("converged"), F.lit(z) * spread * F.col("y_scale"))
    out = j.select(*bars.columns, "yhat", (F.col("yhat") - half).alias("yhat_lower"),
                   (F.col("yhat") + half).alias("yhat_upper"),
                   (F.col("Close") - F.col("yhat")).alias("residual"))
    flag = ((F.col("Close") < F.col("yhat_lower")) | (F.col("Close") > F.col("yhat_upper"))).cast("int")
    return out.withColumn("band_anomaly", F.coalesce(flag, F.lit(0)))


def baseline_map(bars: DataFrame, n_series: int | None = None) -> DataFrame:
    return score_map(bars, fit_map(bars, n_series), n_series)
