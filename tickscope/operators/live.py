"""Live scoring with stored models: the latest bar of each series, no refit.

Mirrors the reference's live scorer: take the recent history (``lookback_days``
calendar days up to ``as_of``), require ``min_bars`` raw bars, rebuild features on
that window (windows restart at its start), scale with the stored scaler, score
with the stored forest, keep the last feature row, flag it against the stored
per-ticker threshold (fallback -0.60 when no results exist). The latest row is taken before
scoring, so one row a ticker meets its trees.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FALLBACK_THRESHOLD, KEY, LIVE_LOOKBACK_DAYS, MIN_LIVE_BARS, TIME
from . import iforest
from .detect import comparable
from .features import build_features
from .scaler import apply_scaler
from .windows import series_stats

LIVE_COLS = ["ticker", "date", "close", "if_score", "threshold", "anomaly", "daily_ret", "vol_z"]


def as_of_default(bars: DataFrame) -> datetime.datetime | None:
    """Latest bar time over all series: a pass over one column, and one value for the driver."""
    return bars.agg(F.max(TIME)).first()[0]


def recent_window(bars: DataFrame, as_of: Column | datetime.datetime | str | None = None,
                  lookback_days: int = LIVE_LOOKBACK_DAYS) -> DataFrame:
    """Bars of the last ``lookback_days``. Both ends are literals (unless ``as_of`` is a column), so they reach the scan,
    which then skips the history by its statistics."""
    if as_of is None:
        as_of = as_of_default(bars)
    if isinstance(as_of, Column):
        start, end = as_of - F.make_interval(days=F.lit(lookback_days)), as_of
    else:
        end = datetime.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
        start = end - datetime.timedelta(days=lookback_days) if end is not None else None
        start, end = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return bars.filter((F.col(TIME) > start) & (F.col(TIME) <= end))


def score_rows(feat: DataFrame, scaler: DataFrame, forest: DataFrame, keep: list[str]) -> DataFrame:
    """Feature rows scored with stored models; rows of tickers without a model drop out. Of the stored
    tables only the tickers at hand are read."""
    asked = feat.select(KEY).distinct()
    scaled = apply_scaler(feat, scaler.join(asked, KEY, "left_semi"))
    return iforest.score(scaled, forest.join(asked, KEY, "left_semi"), keep)


def with_thresholds(scored: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    """Adds the stored ``threshold`` of the row's ticker, or the fallback."""
    if thresholds is None:
        return scored.withColumn("threshold", F.lit(FALLBACK_THRESHOLD))
    joined = scored.join(thresholds.select(KEY, "threshold"), KEY, "left")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(FALLBACK_THRESHOLD)))


def live_scores(bars: DataFrame, scaler: DataFrame, forest: DataFrame, thresholds: DataFrame | None,
                as_of: Column | datetime.datetime | str | None = None, lookback_days: int = LIVE_LOOKBACK_DAYS,
                min_bars: int = MIN_LIVE_BARS) -> DataFrame:
    recent = recent_window(bars, as_of, lookback_days)
    if min_bars > 0:
        enough = (recent.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") >= min_bars).select(KEY))
        recent = recent.join(enough, KEY, "left_semi")
    feat = build_features(recent, series_stats(recent))
    # only the latest row of a ticker is scored
    rest = [c for c in feat.columns if c != KEY]
    latest = feat.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.col(TIME)).alias("r")).select(KEY, "r.*")
    scored = with_thresholds(score_rows(latest, scaler, forest, ["Close", "daily_return", "volume_zscore"]), thresholds)
    return scored.select(
        KEY, F.col(TIME).alias("date"), F.col("Close").alias("close"), "if_score", "threshold",
        F.coalesce(comparable(F.col("if_score")) <= F.col("threshold"), F.lit(False)).alias("anomaly"),
        F.col("daily_return").alias("daily_ret"), F.col("volume_zscore").alias("vol_z"))


def live_summary(scores: DataFrame) -> DataFrame:
    """How many tickers were scored and how many of them are anomalous."""
    return scores.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.coalesce(F.sum(F.col("anomaly").cast("int")), F.lit(0)).cast("long").alias("n_anomalies"))


def anomalous_tickers(scores: DataFrame) -> DataFrame:
    """The anomalous tickers, one row each."""
    return scores.filter("anomaly").select(KEY).distinct()


def missing_models(spark, forest: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested tickers that have no stored model."""
    req = spark.createDataFrame([(t,) for t in requested], "ticker string")
    return req.join(forest.select(KEY).distinct(), KEY, "left_anti")


def latest_bar(bars: DataFrame) -> DataFrame:
    """The newest bar of each ticker."""
    rest = [c for c in bars.columns if c != KEY]
    return bars.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.col(TIME)).alias("r")).select(KEY, "r.*")


def history_guard(bars: DataFrame, min_bars: int = MIN_LIVE_BARS) -> DataFrame:
    """Per ticker, its bars and whether they are enough for live scoring."""
    counts = bars.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_bars"))
    return counts.withColumn("enough", F.col("n_bars") >= min_bars)
