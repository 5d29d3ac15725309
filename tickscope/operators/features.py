"""Rolling bar features (return, volatility, volume, moving-average, momentum).

All twelve columns come from one sorted pass per series (``over_series``):
look-backs are counted in bars (row frames), never in calendar time, and a
rolling value stays null until its window is full, as with pandas ``rolling(n)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, log_of, ratio
from ..schemas import FEATURE_COLS_ALL, KEY, MODEL_FEATURES, OHLCV, TIME, WARMUP_BARS
from .windows import SeriesStats, gated, over_series


def _feature_pass(df: DataFrame, part: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(TIME)
    w20 = w.rowsBetween(-19, 0)
    w50 = w.rowsBetween(-49, 0)
    close, vol = F.col("Close"), F.col("Volume")
    ratio1 = ratio(close, F.lag(close, 1).over(w))
    df = df.select(
        "*",
        (ratio1 - 1).alias("daily_return"),
        log_of(ratio1).alias("log_return"),
        ratio(F.col("High") - F.col("Low"), close).alias("price_range"),
        (ratio(vol, F.lag(vol, 1).over(w)) - 1).alias("volume_change"),
        ratio(vol - gated(F.avg(vol), vol, w20, 20), gated(F.stddev_samp(vol), vol, w20, 20))
        .alias("volume_zscore"),
        gated(F.avg(close), close, w20, 20).alias("ma_20"),
        gated(F.avg(close), close, w50, 50).alias("ma_50"),
        (ratio(close, F.lag(close, 5).over(w)) - 1).alias("momentum_5d"),
        (ratio(close, F.lag(close, 20).over(w)) - 1).alias("momentum_20d"),
    )
    ret = finite(F.col("daily_return"))
    return df.select(
        "*",
        gated(F.stddev_samp(ret), ret, w20, 20).alias("volatility_20d"),
        ratio(close - F.col("ma_20"), F.col("ma_20")).alias("price_vs_ma20"),
        ratio(close - F.col("ma_50"), F.col("ma_50")).alias("price_vs_ma50"),
    )


def add_features(bars: DataFrame, stats: SeriesStats | None = None) -> DataFrame:
    """Bars plus the twelve feature columns, before the incomplete-row drop."""
    out = over_series(bars, _feature_pass, halo=WARMUP_BARS, stats=stats)
    extra = [c for c in out.columns if c not in [KEY, TIME, *OHLCV, *FEATURE_COLS_ALL]]
    return out.select(KEY, TIME, *OHLCV, *FEATURE_COLS_ALL, *extra)


ON_BAD = ("keep", "drop_rows", "fail_ticker")


def is_finite_row() -> Column:
    """Whether every model input of a feature row is a finite number."""
    return reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() for c in MODEL_FEATURES])


def drop_bad(feat: DataFrame, on_bad: str) -> DataFrame:
    """Feature rows with an infinite model input (a zero close or volume before them, a zero close): ``keep`` them,
    ``drop_rows``, or ``fail_ticker``: no row of that ticker, as a model refuses the whole ticker."""
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    if on_bad == "keep":
        return feat
    if on_bad == "drop_rows":
        return feat.filter(is_finite_row())
    return feat.join(feat.filter(~is_finite_row()).select(KEY).distinct(), KEY, "left_anti").select(*feat.columns)


def build_features(bars: DataFrame, stats: SeriesStats | None = None, on_bad: str = "drop_rows") -> DataFrame:
    """Feature rows: warm-up bars and rows with any missing value removed; infinite ones by ``on_bad``."""
    feat = add_features(bars, stats)
    return drop_bad(feat.na.drop("any", subset=[KEY, TIME, *OHLCV, *FEATURE_COLS_ALL]), on_bad)


def model_features(feat: DataFrame) -> DataFrame:
    """The ten model inputs, in fixed order."""
    return feat.select(KEY, TIME, *MODEL_FEATURES)
