"""Registered queries: sources, features, models, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as bl
from ..operators import iforest
from ..operators.detect import DetectParams, RESULT_COLS, detect, detect_summary, scored_features
from ..operators.features import build_features, model_features
from ..operators.scaler import fit_scaler
from ..operators.live import history_guard, latest_bar
from ..operators.windows import series_stats
from ..schemas import FEATURE_COLS_ALL, MODEL_FEATURES, OHLCV
from ..sources.bars import date_range, load_status, read_table, recent_bars
from . import oracle as O
from .fixtures import (DECOMPOSE, EARLY_ZERO, LATE_ZERO, daily_bars, daily_bars_with_zeros, daily_results, hourly_bars,
                       hourly_results)
from .registry import register

BAR_COLS = ["ticker", "Date", *OHLCV]
FEAT_COLS = [*BAR_COLS, *FEATURE_COLS_ALL]
RESULT_DOUBLES = [c for c in RESULT_COLS if c not in ("ticker", "Date", "if_anomaly", "band_anomaly",
                                                      "consensus_anomaly")]


def _detect_sql(bars_ctes, body: str) -> str:
    return O.with_(O.detect(bars_ctes), body)


# --- sources ---------------------------------------------------------------

@register("bars_hourly", BAR_COLS, OHLCV, O.with_(O.bars_events(), "SELECT * FROM bars"))
def q_bars_hourly(spark, sf):
    from ..sources.bars import bars_from_events
    return bars_from_events(read_table(spark, sf, "events"))


@register("bars_daily", BAR_COLS, OHLCV, O.with_(O.bars_daily(), "SELECT * FROM bars"))
def q_bars_daily(spark, sf):
    from ..sources.bars import bars_from_lineitem
    return bars_from_lineitem(read_table(spark, sf, "lineitem"))


@register("bars_range", BAR_COLS, OHLCV, O.with_(O.bars_daily(), """SELECT * FROM bars
  WHERE "Date" >= TIMESTAMP '1996-01-01' AND "Date" < TIMESTAMP '1998-01-01'"""))
def q_bars_range(spark, sf):
    return date_range(daily_bars(spark, sf), "1996-01-01", "1998-01-01")


LOAD_REQUEST = ["A", "N", "R", "X"]   # "X" has no bars: reported failed


@register("load_status", ["ticker", "n_rows", "ok"], [], O.with_(O.bars_daily(), """
SELECT r.ticker, coalesce(c.n_rows, 0) AS n_rows, c.n_rows IS NOT NULL AS ok
FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS r(ticker)
LEFT JOIN (SELECT ticker, count(*) AS n_rows FROM bars GROUP BY ticker) c USING (ticker)"""))
def q_load_status(spark, sf):
    return load_status(spark, daily_bars(spark, sf), LOAD_REQUEST)


@register("recent_bars", BAR_COLS, OHLCV, O.with_(O.bars_events(), """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "Date" DESC) AS rn FROM bars)
WHERE rn <= 90"""))
def q_recent_bars(spark, sf):
    return recent_bars(hourly_bars(spark, sf), n_bars=90)


@register("latest_bar", BAR_COLS, OHLCV, O.with_(O.bars_daily(), """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "Date" DESC) AS rn FROM bars)
WHERE rn = 1"""))
def q_latest_bar(spark, sf):
    return latest_bar(daily_bars(spark, sf))


@register("history_guard", ["ticker", "n_bars", "enough"], [], O.with_(O.bars_events(), """
SELECT ticker, count(*) AS n_bars, count(*) >= 60 AS enough FROM bars GROUP BY ticker"""))
def q_history_guard(spark, sf):
    return history_guard(hourly_bars(spark, sf))


# --- features ----------------------------------------------------------------

@register("features", FEAT_COLS, [*OHLCV, *FEATURE_COLS_ALL],
          O.with_([*O.bars_events(), *O.features("bars", "features")], "SELECT * FROM features"))
def q_features(spark, sf):
    return build_features(hourly_bars(spark, sf))


@register("features_daily", FEAT_COLS, [*OHLCV, *FEATURE_COLS_ALL],
          O.with_([*O.bars_daily(), *O.features("bars", "features")], "SELECT * FROM features"))
def q_features_daily(spark, sf):
    return build_features(daily_bars(spark, sf))


@register("model_features", ["ticker", "Date", *MODEL_FEATURES], MODEL_FEATURES,
          O.with_([*O.bars_events(), *O.features("bars", "features")],
                  f"SELECT ticker, \"Date\", {', '.join(MODEL_FEATURES)} FROM features"))
def q_model_features(spark, sf):
    return model_features(build_features(hourly_bars(spark, sf)))


# --- models ------------------------------------------------------------------

SCALER_COLS = ["ticker", *[f"{p}_{c}" for c in MODEL_FEATURES for p in ("mean", "std")], "n_rows"]


@register("scaler", SCALER_COLS, [c for c in SCALER_COLS if c not in ("ticker", "n_rows")],
          O.with_([*O.bars_events(), *O.features("bars", "features"), *O.scaler("features")],
                  "SELECT * FROM scaler"))
def q_scaler(spark, sf):
    return fit_scaler(build_features(hourly_bars(spark, sf)))


SCALED_COLS = ["ticker", "Date", *[f"z_{c}" for c in MODEL_FEATURES]]


@register("scaled_features", SCALED_COLS, SCALED_COLS[2:],
          O.with_([*O.bars_events(), *O.features("bars", "features"), *O.scaler("features"),
                   *O.scaled("features")],
                  "SELECT ticker, \"Date\", " + ", ".join(f"x[{i + 1}] AS z_{c}" for i, c in
                                                         enumerate(MODEL_FEATURES)) + " FROM scaled"))
def q_scaled_features(spark, sf):
    scaled, _forest, _stats = scored_features(hourly_bars(spark, sf), with_baseline=False)
    return scaled.select("ticker", "Date", *[F.get(F.col("x"), i).alias(f"z_{c}")
                                             for i, c in enumerate(MODEL_FEATURES)])


_FOREST_CTES = [*O.bars_events(), *O.features("bars", "features"), *O.scaler("features"),
                *O.scaled("features"), *O.forest("scaled", "fo")]


@register("forest_nodes", ["ticker", "t", "node", "feature", "threshold"], ["threshold"],
          O.with_(_FOREST_CTES, "SELECT ticker, t, node, CAST(f AS INTEGER) AS feature, thr AS threshold FROM fo_splits"))
def q_forest_nodes(spark, sf):
    return iforest.forest_nodes(scored_features(hourly_bars(spark, sf), with_baseline=False)[1].forest)


@register("forest_shape", ["ticker", "n_trees", "n_splits", "n_leaves"], [],
          O.with_(_FOREST_CTES, """
SELECT s.ticker, s.n_trees, s.n_splits, l.n_leaves FROM
 (SELECT ticker, count(DISTINCT t) AS n_trees, count(*) AS n_splits FROM fo_splits GROUP BY ticker) s
 JOIN (SELECT ticker, count(*) AS n_leaves FROM fo_leaves GROUP BY ticker) l USING (ticker)"""))
def q_forest_shape(spark, sf):
    forest = scored_features(hourly_bars(spark, sf), with_baseline=False)[1].forest
    return forest.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_trees"),
                                        F.sum("n_splits").cast("long").alias("n_splits"),
                                        F.sum("n_leaves").cast("long").alias("n_leaves"))


@register("if_scores", ["ticker", "Date", "mean_path", "if_score"], ["mean_path", "if_score"],
          O.with_([*_FOREST_CTES, *O.score("scaled", "fo")], "SELECT ticker, \"Date\", mean_path, if_score FROM scores"))
def q_if_scores(spark, sf):
    scaled, models, _stats = scored_features(hourly_bars(spark, sf), with_baseline=False)
    return iforest.score(scaled, models.forest, keep=[])


# --- baseline ----------------------------------------------------------------

BASE_COLS = ["ticker", "Date", "Close", "yhat", "yhat_lower", "yhat_upper", "residual", "band_anomaly"]


@register("baseline_scores", BASE_COLS, ["Close", "yhat", "yhat_lower", "yhat_upper", "residual"],
          O.with_([*O.bars_daily(), *O.baseline("bars", "bl")], "SELECT * FROM bl"))
def q_baseline_scores(spark, sf):
    b = daily_bars(spark, sf)
    return bl.baseline(b, series_stats(b).n_series)


@register("baseline_fit", ["ticker", "t_mean", "y_mean", "slope", "sigma"],
          ["t_mean", "y_mean", "slope", "sigma"],
          O.with_([*O.bars_daily(), *O.baseline("bars", "bl")],
                  "SELECT ticker, t_mean, y_mean, slope, sigma FROM bl_fit"))
def q_baseline_fit(spark, sf):
    b = daily_bars(spark, sf)
    trend, _w, _y = bl.fit_decompose(b, series_stats(b).n_series)
    return trend


@register("band_flags", ["ticker", "n_bars", "n_band"], [],
          O.with_([*O.bars_events(), *O.baseline("bars", "bl")],
                  "SELECT ticker, count(*) AS n_bars, CAST(sum(band_anomaly) AS BIGINT) AS n_band FROM bl GROUP BY ticker"))
def q_band_flags(spark, sf):
    b = hourly_bars(spark, sf)
    return (bl.baseline(b, series_stats(b).n_series).groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("n_bars"), F.sum("band_anomaly").cast("long").alias("n_band")))


# --- detection ---------------------------------------------------------------

@register("detect", RESULT_COLS, RESULT_DOUBLES,
          _detect_sql(O.bars_events(), "SELECT * FROM results"))
def q_detect(spark, sf):
    """Detection run: fits and stores the models, writes and returns the result table."""
    return hourly_results(spark, sf)


@register("detect_daily", RESULT_COLS, RESULT_DOUBLES,
          _detect_sql(O.bars_daily(), "SELECT * FROM results"))
def q_detect_daily(spark, sf):
    return daily_results(spark, sf)


@register("if_threshold", ["ticker", "threshold"], ["threshold"],
          _detect_sql(O.bars_events(), "SELECT * FROM thresholds"))
def q_if_threshold(spark, sf):
    from ..operators.detect import if_threshold
    b = hourly_bars(spark, sf)
    scaled, models, _stats = scored_features(b, with_baseline=False)
    return if_threshold(iforest.score(scaled, models.forest, keep=[]), DetectParams().percentile)


SUMMARY_COLS = ["ticker", "n_rows", "n_if", "n_band", "n_consensus", "threshold"]


@register("detect_summary", SUMMARY_COLS, ["threshold"], _detect_sql(O.bars_events(), """
SELECT r.ticker, count(*) AS n_rows, CAST(sum(if_anomaly) AS BIGINT) AS n_if,
       CAST(sum(band_anomaly) AS BIGINT) AS n_band, CAST(sum(consensus_anomaly) AS BIGINT) AS n_consensus,
       any_value(t.threshold) AS threshold
FROM results r JOIN thresholds t USING (ticker) GROUP BY r.ticker"""))
def q_detect_summary(spark, sf):
    from ..operators.detect import detect_with_threshold
    r = detect_with_threshold(hourly_bars(spark, sf), DECOMPOSE)
    thr = r.groupBy("ticker").agg(F.first("threshold").alias("threshold"))
    return detect_summary(r, thr)


@register("consensus", ["ticker", "Date", "Close", "if_score", "residual"], ["Close", "if_score", "residual"],
          _detect_sql(O.bars_events(), 'SELECT ticker, "Date", "Close", if_score, residual FROM results WHERE consensus_anomaly = 1'))
def q_consensus(spark, sf):
    r = detect(hourly_bars(spark, sf), DECOMPOSE)
    return r.filter(F.col("consensus_anomaly") == 1)


STATUS_REQUEST = ["A", "N", "R", "X"]


def _status_sql(src: str) -> str:
    """From the definitions: a row survives the drop if no feature is undefined (0 / 0, a short window, an infinite return in a
    window); it is bad if a surviving model input is infinite (x / 0, the logarithm of 0)."""
    return f"""
SELECT r.ticker, coalesce(b.n_bars, 0) AS n_bars, coalesce(f.n, 0) AS n_feature_rows, reason IS NULL AS ok, reason
FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS r(ticker)
LEFT JOIN (SELECT ticker, count(*) AS n_bars FROM {src} GROUP BY ticker) b USING (ticker)
LEFT JOIN (
  SELECT ticker, count(*) AS n, max(CAST(("Close" = 0 AND c1 > 0) OR ("Close" = 0 AND "High" <> "Low") OR (v1 = 0 AND "Volume" <> 0) AS INTEGER)) AS bad
  FROM (
    SELECT *, "Close" AS c, row_number() OVER w AS pos, lag("Close") OVER w AS c1, lag("Volume") OVER w AS v1,
           min("Close") OVER (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS low_before,
           stddev_samp("Volume") OVER (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sv
    FROM {src} WINDOW w AS (PARTITION BY ticker ORDER BY "Date"))
  WHERE pos >= 50 AND low_before > 0 AND sv > 0 AND NOT ("Close" = 0 AND "High" = "Low") AND NOT (v1 = 0 AND "Volume" = 0)
  GROUP BY ticker) f USING (ticker),
LATERAL (SELECT CASE WHEN coalesce(b.n_bars, 0) = 0 THEN 'no data' WHEN coalesce(f.n, 0) < 2 THEN 'too few feature rows'
                     WHEN f.bad > 0 THEN 'non-finite feature' END AS reason)"""


@register("detect_status", ["ticker", "n_bars", "n_feature_rows", "ok", "reason"], [], O.with_(O.bars_daily(), _status_sql("bars")))
def q_detect_status(spark, sf):
    from ..operators.detect import detect_status
    return detect_status(daily_bars(spark, sf), STATUS_REQUEST)


ZEROS = [f"""zeros AS (
  SELECT * EXCLUDE (pos, "Volume"), CASE WHEN (ticker = '{EARLY_ZERO[0]}' AND pos = {EARLY_ZERO[1]}) OR (ticker = '{LATE_ZERO[0]}' AND pos = {LATE_ZERO[1]})
         THEN 0 ELSE "Volume" END AS "Volume" FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "Date") - 1 AS pos FROM bars))"""]


@register("detect_gate", ["ticker", "n_bars", "n_feature_rows", "ok", "reason"], [], O.with_([*O.bars_daily(), *ZEROS], _status_sql("zeros")))
def q_detect_gate(spark, sf):
    """A zero volume inside the warm-up does no harm, one past it fails its ticker."""
    from ..operators.detect import detect_status
    return detect_status(daily_bars_with_zeros(spark, sf), STATUS_REQUEST)


@register("detect_gate_rows", ["ticker", "n_rows"], [], O.with_(O.bars_daily(), f"""
SELECT ticker, count(*) - 49 AS n_rows FROM bars WHERE ticker <> '{LATE_ZERO[0]}' GROUP BY ticker"""))
def q_detect_gate_rows(spark, sf):
    """The run gives no row of the failed ticker and all feature rows of the others."""
    r = detect(daily_bars_with_zeros(spark, sf), DECOMPOSE)
    return r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))


@register("if_flags", ["ticker", "Date", "if_score", "if_anomaly"], ["if_score"],
          _detect_sql(O.bars_events(), 'SELECT ticker, "Date", if_score, if_anomaly FROM results'))
def q_if_flags(spark, sf):
    return hourly_results(spark, sf).select("ticker", "Date", "if_score", "if_anomaly")


@register("baseline_map", BASE_COLS, ["Close", "yhat", "yhat_lower", "yhat_upper", "residual"], None,
          note="MAP changepoint/seasonality fit: rows-only check; its sums and its optimality have keys of their own")
def q_baseline_map(spark, sf):
    from ..operators.baseline_map import baseline_map
    b = daily_bars(spark, sf)
    return baseline_map(b, series_stats(b).n_series)


@register("map_gram", ["ticker", "i", "j", "value"], ["value"], O.with_([*O.bars_daily(), *O.design()], """
SELECT ticker, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(z[i + 1] * z[j + 1]) AS value
FROM dz, range(0, 54) AS a(i), range(0, 54) AS b(j) WHERE i <= j GROUP BY 1, 2, 3"""))
def q_map_gram(spark, sf):
    """The sums that the MAP fit rests on: the upper triangle of Z'Z, Z = [X y]."""
    from ..operators import baseline_map as bm
    b = daily_bars(spark, sf)
    sums = bm.gram_sums(b, bm.series_scalars(b), series_stats(b).n_series)
    at = [F.get(F.array(*[F.lit(int(k)) for k in index]), F.col("pos")) for index in bm.TRIANGLE]
    return sums.select("ticker", at[0].alias("i"), at[1].alias("j"), F.col("v").alias("value"))


@register("map_kkt", ["ticker", "converged"], [], O.with_(O.bars_brands(), "SELECT DISTINCT ticker, true AS converged FROM bars"))
def q_map_kkt(spark, sf):
    """Every series' MAP fit meets its optimality conditions."""
    from ..operators.baseline_map import fit_map
    from .fixtures import brand_bars
    b = brand_bars(spark, sf)
    return fit_map(b, series_stats(b).n_series).select("ticker", "converged")


@register("detect_map", RESULT_COLS, RESULT_DOUBLES, None,
          note="full detection with the MAP band: rows-only check")
def q_detect_map(spark, sf):
    return daily_results(spark, sf, DetectParams())


@register("bars_brands", BAR_COLS, OHLCV, O.with_(O.bars_brands(), "SELECT * FROM bars"))
def q_bars_brands(spark, sf):
    from ..sources.bars import bars_from_brands
    return bars_from_brands(read_table(spark, sf, "lineitem"), read_table(spark, sf, "part"))


@register("features_brands", FEAT_COLS, [*OHLCV, *FEATURE_COLS_ALL],
          O.with_([*O.bars_brands(), *O.features("bars", "features")], "SELECT * FROM features"))
def q_features_brands(spark, sf):
    from .fixtures import brand_bars
    return build_features(brand_bars(spark, sf))


@register("detect_brands", RESULT_COLS, RESULT_DOUBLES, _detect_sql(O.bars_brands(), "SELECT * FROM results"))
def q_detect_brands(spark, sf):
    from .fixtures import brand_results
    return brand_results(spark, sf)
