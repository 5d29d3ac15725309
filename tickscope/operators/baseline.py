"""Trend + weekly + yearly baseline and its 95 % band (method ``decompose``).

Per series: least-squares linear trend on time (days, centred), then the mean
detrended value by day of week, then the mean of what remains by month of year;
yhat = trend + weekly + yearly, sigma = sample std of y - yhat, band =
yhat +/- z * sigma. Every step is a partial-aggregated ``groupBy`` whose small
per-series result is joined back, so a series of any length is never held by
one task. Daily seasonality is off (as in the reference configuration).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import INTERVAL_Z, KEY, TIME
from .joins import join_small

DAY_MICROS = 86_400_000_000.0


def _t_days(col):
    return F.unix_micros(col.cast("timestamp")) / F.lit(DAY_MICROS)


def fit_decompose(bars: DataFrame, n_series: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model tables: per-series trend (t_mean, y_mean, slope, sigma), weekly and yearly terms."""
    b = bars.select(KEY, _t_days(F.col(TIME)).alias("_t"), F.col("Close").alias("_y"),
                    F.dayofweek(TIME).alias("dow"), F.month(TIME).alias("moy"))
    trend = b.groupBy(KEY).agg(
        F.avg("_t").alias("t_mean"), F.avg("_y").alias("y_mean"),
        F.coalesce(F.try_divide(F.covar_pop("_t", "_y"), F.var_pop("_t")), F.lit(0.0)).alias("slope"))
    b = join_small(b, trend, KEY, n_series)
    b = b.withColumn("_r1", F.col("_y") - (F.col("y_mean") + F.col("slope") * (F.col("_t") - F.col("t_mean"))))
    weekly = b.groupBy(KEY, "dow").agg(F.avg("_r1").alias("weekly"))
    b = join_small(b, weekly, [KEY, "dow"], None if n_series is None else n_series * 7)
    b = b.withColumn("_r2", F.col("_r1") - F.col("weekly"))
    yearly = b.groupBy(KEY, "moy").agg(F.avg("_r2").alias("yearly"))
    b = join_small(b, yearly, [KEY, "moy"], None if n_series is None else n_series * 12)
    resid = F.col("_r2") - F.col("yearly")
    sigma = b.groupBy(KEY).agg(F.coalesce(F.stddev_samp(resid), F.lit(0.0)).alias("sigma"))
    trend = trend.join(sigma, KEY)
    return trend, weekly, yearly


def model_table(model: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The three model tables as one row a ticker: weekly and yearly terms as maps (at most 7 and 12 entries)."""
    trend, weekly, yearly = model
    by_dow = weekly.groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dow", "weekly")))).alias("weekly"))
    by_moy = yearly.groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("moy", "yearly")))).alias("yearly"))
    return trend.join(by_dow, KEY, "left").join(by_moy, KEY, "left")


def from_model_table(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (table.drop("weekly", "yearly"), table.select(KEY, F.explode("weekly").alias("dow", "weekly")),
            table.select(KEY, F.explode("yearly").alias("moy", "yearly")))


def score_decompose(bars: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame],
                    n_series: int | None = None, z: float = INTERVAL_Z) -> DataFrame:
    """Adds yhat, yhat_lower, yhat_upper, residual, band_anomaly to every bar."""
    trend, weekly, yearly = model
    b = bars.withColumn("dow", F.dayofweek(TIME)).withColumn("moy", F.month(TIME))
    b = join_small(b, trend, KEY, n_series)
    b = join_small(b, weekly, [KEY, "dow"], None if n_series is None else n_series * 7, "left")
    b = join_small(b, yearly, [KEY, "moy"], None if n_series is None else n_series * 12, "left")
    t = _t_days(F.col(TIME))
    yhat = (F.col("y_mean") + F.col("slope") * (t - F.col("t_mean"))
            + F.coalesce(F.col("weekly"), F.lit(0.0)) + F.coalesce(F.col("yearly"), F.lit(0.0)))
    b = b.withColumn("yhat", yhat)
    half = F.lit(z) * F.col("sigma")
    y = F.col("Close")
    out = b.select(*bars.columns, "yhat",
                   (F.col("yhat") - half).alias("yhat_lower"),
                   (F.col("yhat") + half).alias("yhat_upper"),
                   (y - F.col("yhat")).alias("residual"))
    flag = ((F.col("Close") < F.col("yhat_lower")) | (F.col("Close") > F.col("yhat_upper"))).cast("int")
    return out.withColumn("band_anomaly", flag)


def baseline(bars: DataFrame, n_series: int | None = None) -> DataFrame:
    """Fit on all raw bars, then score the same bars."""
    return score_decompose(bars, fit_decompose(bars, n_series), n_series)
