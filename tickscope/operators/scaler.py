"""Per-series standard scaler: mean and population std, zero std treated as 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY, MODEL_FEATURES
from .joins import join_small


def fit_scaler(feat: DataFrame, cols: list[str] = MODEL_FEATURES) -> DataFrame:
    """One row per ticker: ``mean_<c>``, ``std_<c>`` (partial aggregation, skew-safe)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"mean_{c}"))
        sd = F.stddev_pop(c)
        aggs.append(F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"std_{c}"))
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    return feat.groupBy(KEY).agg(*aggs)


def apply_scaler(feat: DataFrame, scaler: DataFrame, cols: list[str] = MODEL_FEATURES,
                 n_series: int | None = None) -> DataFrame:
    """Adds ``x`` = array of scaled model inputs using the stored mean and std."""
    stats = scaler.select(KEY, *[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])
    joined = join_small(feat, stats, KEY, n_series)
    x = F.array(*[(F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in cols])
    return joined.select(*feat.columns, x.alias("x"))
