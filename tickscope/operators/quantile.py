"""Exact per-series quantile with linear interpolation (pandas ``quantile``).

No group ever holds a whole series:
  1. equal values are counted once (map-side combine), so ties cost nothing;
  2. a histogram of the distinct values on a fixed grid of cells gives running counts;
  3. only the values in the one or two cells that hold ranks k and k+1 are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY

GRID_BITS = 24   # cell width 2^-24 for values in (-1, 1)


def quantile_by_key(df: DataFrame, value: str, q: float, out: str = "quantile") -> DataFrame:
    """One row per ticker with a value: its q-quantile (nulls are skipped)."""
    base = df.select(KEY, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    base = base.groupBy(KEY, "_v").agg(F.count(F.lit(1)).alias("_c"))
    base = base.withColumn("_cell", F.floor(F.col("_v") * F.lit(float(2 ** GRID_BITS))).cast("long"))
    hist = base.groupBy(KEY, "_cell").agg(F.sum("_c").alias("_cc"))
    wc = Window.partitionBy(KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("_before", F.coalesce(F.sum("_cc").over(wc), F.lit(0)))
            .withColumn("_n", F.sum("_cc").over(Window.partitionBy(KEY))))
    pos = F.lit(q) * (F.col("_n") - 1)
    hist = (hist.withColumn("_k", F.floor(pos).cast("long"))
            .withColumn("_k1", F.least(F.col("_k") + 1, F.col("_n") - 1))
            .withColumn("_frac", pos - F.col("_k")))
    in_cell = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_cc"))
    targets = hist.filter(in_cell(F.col("_k")) | in_cell(F.col("_k1"))).select(
        KEY, "_cell", "_before", "_k", "_k1", "_frac")
    cands = base.join(targets, [KEY, "_cell"])
    wr = Window.partitionBy(KEY, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (cands.withColumn("_last", F.col("_before") + F.sum("_c").over(wr) - 1)
              .withColumn("_first", F.col("_last") - F.col("_c") + 1))
    holds = lambda r: (F.col("_first") <= r) & (r <= F.col("_last"))
    picked = ranked.groupBy(KEY).agg(
        F.max(F.when(holds(F.col("_k")), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.col("_k1")), F.col("_v"))).alias("_hi"),
        F.first("_frac").alias("_frac"))
    return picked.select(KEY, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(out))
