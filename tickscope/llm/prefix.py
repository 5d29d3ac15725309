"""Running sums over groups of any size, in DataFrame operations.

A window over a whole group would put a hot group into one task. Here the order key is cut into
fixed buckets (the caller gives the bucket; it must not fall as the order rises), bucket totals
are aggregated with map-side combine, and a row's running sum is the total of the buckets before
plus the running sum inside its own bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, group: str, bucket: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the group up to and including this one.

    ``rows`` is read twice, so it should be a table or a checkpoint; ``group`` and ``bucket`` must not be null.
    """
    before, own = f"{out}__before", f"{out}__own"
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias(own))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, bucket, F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, [group, bucket]).withColumn(out, F.col(before) + F.sum(value).over(inside)).drop(before)
