"""Detection: features -> scaler -> forest -> IF flag; baseline -> band flag; consensus.

Tickers whose surviving feature rows hold an infinite model input fail as a whole by default
(``on_bad``), the others are unaffected; if no ticker is left the run is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round_half_away
from ..schemas import (ANOMALY_PERCENTILE, FEATURE_COLS_ALL, KEY, MAX_SAMPLES, N_TREES, OHLCV,
                       SEED, TIME)
from . import baseline as bl
from . import baseline_map as bm
from . import iforest
from .features import build_features, drop_bad, is_finite_row
from .joins import join_small
from .quantile import quantile_by_key
from .scaler import apply_scaler, fit_scaler
from .windows import SeriesStats, series_stats

RESULT_COLS = [KEY, TIME, *OHLCV, *FEATURE_COLS_ALL, "if_score", "if_anomaly",
               "yhat", "yhat_lower", "yhat_upper", "residual", "band_anomaly", "consensus_anomaly"]
# Scores are compared at this many digits, above the last-bit noise of a sum over trees.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class DetectParams:
    n_trees: int = N_TREES
    max_samples: int = MAX_SAMPLES
    seed: int = SEED
    percentile: float = ANOMALY_PERCENTILE
    baseline: str = "map"           # changepoint trend + Fourier seasonality; or "decompose"
    on_bad: str = "fail_ticker"     # or "drop_rows": see features.drop_bad


@dataclass(frozen=True)
class Models:
    """Stored model tables: scaler, forest and the baseline's (None: fitted anew)."""
    scaler: DataFrame
    forest: DataFrame
    baseline: DataFrame | None = None


def fit_baseline(bars: DataFrame, params: DetectParams, stats: SeriesStats) -> DataFrame:
    """The baseline's model table: one row a ticker."""
    if params.baseline == "map":
        return bm.fit_map(bars, stats.n_series)
    return bl.model_table(bl.fit_decompose(bars, stats.n_series))


def band(bars: DataFrame, model: DataFrame, params: DetectParams, stats: SeriesStats) -> DataFrame:
    """Baseline columns on every raw bar, by the chosen method."""
    if params.baseline == "map":
        return bm.score_map(bars, model, stats.n_series)
    return bl.score_decompose(bars, bl.from_model_table(model), stats.n_series)


def comparable(score):
    return round_half_away(score, SCORE_DIGITS)


def if_threshold(scored: DataFrame, q: float) -> DataFrame:
    """Per-ticker score quantile (linear interpolation), exact: a narrow aggregate of (ticker, score)."""
    return quantile_by_key(scored.select(KEY, comparable(F.col("if_score")).alias("if_score")), "if_score", q, out="threshold")


def if_flags(scored: DataFrame, thresholds: DataFrame, n_series: int | None = None) -> DataFrame:
    j = join_small(scored, thresholds.select(KEY, "threshold"), KEY, n_series, "left")
    return j.withColumn("if_anomaly", F.coalesce(comparable(F.col("if_score")) <= F.col("threshold"), F.lit(False)).cast("int"))


def consensus(df: DataFrame) -> DataFrame:
    both = (F.col("if_anomaly") == 1) & (F.col("band_anomaly") == 1)
    return df.withColumn("consensus_anomaly", F.coalesce(both, F.lit(False)).cast("int"))


def _checkpointed(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def scored_features(bars: DataFrame, params: DetectParams | None = None,
                    stats: SeriesStats | None = None, with_baseline: bool = True,
                    models: Models | None = None, cut=None, store=None):
    """(feature rows with scaled ``x`` [+ baseline columns], models, stats).

    ``models`` are used as they are (no refit), like the reference reusing its saved artefacts; what is missing is
    fitted on ``bars``. ``store(name, df) -> df`` may write each model table before it is used, so the
    results are scored with exactly the stored models. ``cut(df) -> df`` materialises the feature rows, which the
    scaler, the forest and the scoring all read (default: a checkpoint; a parquet table lets later passes read
    only the columns they need).
    """
    params = params or DetectParams()
    stats = stats or series_stats(bars)
    store = store or (lambda _name, df: df)
    base = models.baseline if models is not None else None
    if with_baseline and base is None:
        base = store("baseline", fit_baseline(bars, params, stats))
    src = band(bars, base, params, stats) if with_baseline else bars
    feat = drop_bad((cut or _checkpointed)(build_features(src, stats, on_bad="keep")), params.on_bad)
    if feat.isEmpty():
        raise ValueError("no ticker has feature rows that a model can take")
    scaler = models.scaler if models is not None else store("scaler", fit_scaler(feat))
    scaled = apply_scaler(feat, scaler, n_series=stats.n_series)
    forest = models.forest if models is not None else store(
        "forest", iforest.fit_forest(scaled, params.n_trees, params.max_samples, params.seed, stats.n_series))
    return scaled, Models(scaler, forest, base), stats


def _flagged(bars: DataFrame, params: DetectParams, models: Models | None, store=None, cut=None) -> tuple[Models, DataFrame]:
    scaled, models, stats = scored_features(bars, params, models=models, store=store, cut=cut)
    # read twice, by the threshold and by the flags: the trees are walked once
    scored = iforest.score(scaled, models.forest).checkpoint(eager=True)
    return models, consensus(if_flags(scored, if_threshold(scored, params.percentile), stats.n_series))


def fit_and_detect(bars: DataFrame, params: DetectParams | None = None,
                   store=None, cut=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and score in one pass: (scaler, forest, results); ``store`` also gets the baseline model."""
    models, flagged = _flagged(bars, params or DetectParams(), None, store, cut)
    return models.scaler, models.forest, flagged.select(*RESULT_COLS)


def detect(bars: DataFrame, params: DetectParams | None = None, models: Models | None = None) -> DataFrame:
    """Full result table: features, IF score/flag, band, residual, consensus."""
    return detect_with_threshold(bars, params, models).select(*RESULT_COLS)


def detect_with_threshold(bars: DataFrame, params: DetectParams | None = None, models: Models | None = None) -> DataFrame:
    return _flagged(bars, params or DetectParams(), models)[1]


def detect_summary(results: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Per-ticker flag counts (IF, band, consensus) and rows."""
    agg = results.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("if_anomaly").cast("long").alias("n_if"),
        F.sum("band_anomaly").cast("long").alias("n_band"),
        F.sum("consensus_anomaly").cast("long").alias("n_consensus"))
    if thresholds is not None:
        agg = agg.join(thresholds, KEY, "left")
    return agg


def detect_status(bars: DataFrame, requested: list[str], min_feature_rows: int = 2) -> DataFrame:
    """Per requested ticker, whether detection can run and why not.

    A ticker fails when it has no bars, when too few feature rows survive the warm-up and missing-value drop, or
    when a surviving row holds an infinite model input (the reference's model refuses that whole ticker). It is
    the same test that keeps a failed ticker out of the run.
    """
    spark = bars.sparkSession
    feat = build_features(bars, series_stats(bars), on_bad="keep")
    counts = bars.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_bars"))
    good = feat.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_feature_rows"), F.max((~is_finite_row()).cast("int")).alias("_bad"))
    req = spark.createDataFrame([(t,) for t in requested], f"{KEY} string")
    j = req.join(counts, KEY, "left").join(good, KEY, "left")
    n_bars = F.coalesce(F.col("n_bars"), F.lit(0))
    n_feat = F.coalesce(F.col("n_feature_rows"), F.lit(0))
    reason = (F.when(n_bars == 0, F.lit("no data"))
              .when(n_feat < min_feature_rows, F.lit("too few feature rows"))
              .when(F.col("_bad") > 0, F.lit("non-finite feature")))
    return j.select(KEY, n_bars.alias("n_bars"), n_feat.alias("n_feature_rows"),
                    reason.isNull().alias("ok"), reason.alias("reason"))


def train_or_reuse(bars: DataFrame, stored: Models | None, retrain: bool,
                   params: DetectParams | None = None) -> Models:
    """Models for tickers without stored artefacts (or all, when ``retrain``) are
    fitted; stored ones are reused as they are (the reference never refits a ticker
    whose artefacts exist, even when new bars arrive)."""
    params = params or DetectParams()
    if stored is None or retrain:
        return scored_features(bars, params)[1]
    fitted = stored.forest.select(KEY).distinct()
    if stored.baseline is not None:
        fitted = fitted.join(stored.baseline.select(KEY).distinct(), KEY, "left_semi")
    todo = bars.join(fitted, KEY, "left_anti")
    if todo.isEmpty():
        return stored
    new = scored_features(todo, params, with_baseline=stored.baseline is not None)[1]

    def both(old: DataFrame | None, fresh: DataFrame | None) -> DataFrame | None:
        if old is None or fresh is None:
            return old
        known = old.join(fresh.select(KEY).distinct(), KEY, "left_anti")
        return known.select(*old.columns).unionByName(fresh.select(*old.columns))
    return Models(both(stored.scaler, new.scaler), both(stored.forest, new.forest), both(stored.baseline, new.baseline))


def with_reference_names(results: DataFrame) -> DataFrame:
    """Result table under the reference's column names (band flag = ``prophet_anomaly``)."""
    return results.withColumnRenamed("band_anomaly", "prophet_anomaly")
