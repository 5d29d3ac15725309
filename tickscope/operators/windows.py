"""Ordered per-series windows that stay balanced when one series is huge.

Features look back a fixed number of bars (``halo``). A series is cut into chunks of about
``target_rows`` counted rows (a short series is one chunk):

1. bars are counted per (ticker, time cell), cells being about 1/1024 of a chunk; the running count
   numbers the chunks, so bursts of bars get more chunks, not larger ones;
2. a window over ``(ticker, chunk)``: rows whose whole look-back lies inside their chunk
   (position > halo, or the series' first chunk) are final;
3. the first ``halo`` rows of each later chunk need earlier bars. Those rows, plus the last
   ``halo`` rows of every chunk, form a small "edge" series (2*halo rows per chunk). Every bar within ``halo``
   positions before an edge-head row is itself in the edge series, so the same window over it
   gives the exact values for the head rows. The edge series is handled by this same function, so it
   is cut in turn when it is long.

If no series is longer than a chunk, every chunk number is 0 and there are no edges: steps 1 and 3
are left out. The longest series' length is one small aggregate, remembered per plan.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY, TIME

# Rows per window task we are happy to sort in one piece.
TARGET_ROWS_PER_TASK = 1_000_000
CELLS_PER_CHUNK = 1024


@dataclass(frozen=True)
class SeriesStats:
    n_series: int
    max_rows: int
    cell_micros: int = 0   # width of a counting cell; 0: no series is longer than a chunk
    total_rows: int = 0
    target_rows: int = TARGET_ROWS_PER_TASK

    @property
    def chunked(self) -> bool:
        return self.cell_micros > 0


_STATS_MEMO: OrderedDict[tuple, SeriesStats] = OrderedDict()
_STATS_MEMO_MAX = 256


def series_stats(df: DataFrame, key: str = KEY, order: str = TIME,
                 target_rows: int | None = None) -> SeriesStats:
    """Number of series and their largest row count (one partial-aggregated job)."""
    if target_rows is None:
        target_rows = TARGET_ROWS_PER_TASK
    memo_key = (df.semanticHash(), key, order, target_rows)
    hit = _STATS_MEMO.get(memo_key)
    if hit is not None:
        return hit
    per = (df.groupBy(key)
           .agg(F.count(F.lit(1)).alias("n"),
                (F.unix_micros(F.max(order).cast("timestamp"))
                 - F.unix_micros(F.min(order).cast("timestamp")) + 1).alias("span")))
    width = F.col("span").cast("double") * F.lit(target_rows / CELLS_PER_CHUNK) / F.col("n")
    row = per.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m"), F.sum("n").alias("tot"),
                  F.min(F.when(F.col("n") > target_rows, width)).alias("w")).first()
    cell = int(row["w"]) + 1 if row["w"] is not None else 0
    stats = SeriesStats(int(row["k"] or 0), int(row["m"] or 0), cell, int(row["tot"] or 0), target_rows)
    _STATS_MEMO[memo_key] = stats
    while len(_STATS_MEMO) > _STATS_MEMO_MAX:
        _STATS_MEMO.popitem(last=False)
    return stats


def _numbered(df: DataFrame, key: str, order: str, stats: SeriesStats, chunk: str) -> DataFrame:
    """``df`` with its chunk number: running count of the cells before / target rows."""
    cell = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / F.lit(stats.cell_micros))
    d = df.withColumn("_cell", cell)
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(key, "_cell", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                                               / F.lit(stats.target_rows)).alias(chunk))
    return d.join(cells, [key, "_cell"]).select(*df.columns, chunk)


def over_series(df: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], halo: int,
                key: str = KEY, order: str = TIME, stats: SeriesStats | None = None, depth: int = 0) -> DataFrame:
    """Apply ``fn(df, partition_cols)`` — row-frame windows ordered by ``order`` with a
    look-back of at most ``halo`` rows — exactly, whatever the series sizes."""
    if stats is None:
        stats = series_stats(df, key, order)
    if not stats.chunked:
        return fn(df, [key])
    chunk, rn, cnt = (f"_{name}{depth}" for name in ("chunk", "rn", "cnt"))
    part = [key, chunk]
    d = _numbered(df, key, order, stats, chunk)
    wc = Window.partitionBy(*part).orderBy(order)
    d = (d.withColumn(rn, F.row_number().over(wc))
         .withColumn(cnt, F.count(F.lit(1)).over(Window.partitionBy(*part))))
    final = (F.col(rn) > halo) | (F.col(chunk) == 0)
    main = fn(d, part).filter(final)
    edge = d.filter((F.col(rn) <= halo) | (F.col(cnt) - F.col(rn) < halo))
    edge_stats = series_stats(edge, key, order, stats.target_rows)
    if 2 * edge_stats.max_rows > stats.max_rows:   # chunks of few rows: the edges are no shorter series
        edge_stats = SeriesStats(edge_stats.n_series, edge_stats.max_rows, 0, edge_stats.total_rows)
    fixed = over_series(edge, fn, halo, key, order, edge_stats, depth + 1).filter(~final)
    return main.unionByName(fixed).drop(chunk, rn, cnt)


def gated(agg: Column, counted: Column, w, n: int) -> Column:
    """pandas ``rolling(n)`` semantics: null until ``n`` non-null values are in the frame."""
    return F.when(F.count(counted).over(w) == n, agg.over(w))
