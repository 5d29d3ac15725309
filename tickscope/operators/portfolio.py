"""Portfolio analytics over the detection results (the dashboard's queries).

Input is the result table; ``port`` applies the closed calendar-date range and the
ticker selection *before* any per-ticker lag or rolling window, so windows restart
at the range start. Per-ticker first/last values use ``min_by``/``max_by``
aggregates (partial-aggregated, no sort); look-back windows go through
``over_series`` so one huge ticker never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY, ROLLING_RATE_BARS, TIME, TOP_ANOMALIES
from ..functions.exprs import round_half_away
from .joins import join_small
from .detect import if_threshold
from .windows import gated, over_series

MONTH_FMT = "yyyy-MM"

# Fixed values from the reference dashboard: display labels for known tickers.
TICKER_LABELS = {
    "SPY": "SPY — S&P 500",
    "QQQ": "QQQ — Nasdaq 100",
    "GLD": "GLD — Gold ETF",
    "BTC-USD": "BTC — Bitcoin",
    "AAPL": "AAPL — Apple",
}


def pct_of(x: Column, n: Column) -> Column:
    return F.lit(100.0) * x / F.greatest(n, F.lit(1))


def port(results: DataFrame, start: str | None = None, end: str | None = None,
         tickers: Sequence[str] | None = None) -> DataFrame:
    """A1: closed date range on the calendar date, ticker selection."""
    cond = F.lit(True)
    day = F.to_date(F.col(TIME))
    if start is not None:
        cond = cond & (day >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (day <= F.lit(end).cast("date"))
    if tickers is not None:
        cond = cond & F.col(KEY).isin(list(tickers))
    return results.filter(cond)


def tickers(results: DataFrame) -> DataFrame:
    """A2: sorted distinct tickers."""
    return results.select(KEY).distinct().orderBy(KEY)


def extent(results: DataFrame) -> DataFrame:
    """A3: first and last date, total rows."""
    return results.agg(F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"),
                       F.count(F.lit(1)).alias("n_rows"))


def kpis(p: DataFrame) -> DataFrame:
    """A4: flag totals and their share of all rows (in %)."""
    n = F.count(F.lit(1))
    out = p.agg(n.alias("total_rows"),
                F.coalesce(F.sum("if_anomaly"), F.lit(0)).cast("long").alias("total_if"),
                F.coalesce(F.sum("band_anomaly"), F.lit(0)).cast("long").alias("total_band"),
                F.coalesce(F.sum("consensus_anomaly"), F.lit(0)).cast("long").alias("total_consensus"))
    return out.select("*", *[pct_of(F.col(f"total_{k}"), F.col("total_rows")).alias(f"pct_{k}")
                             for k in ("if", "band", "consensus")])


def most_flagged(p: DataFrame) -> DataFrame:
    """A5: ticker with the most consensus flags (ties: alphabetically first), '—' if none."""
    per = p.groupBy(KEY).agg(F.sum("consensus_anomaly").cast("long").alias("n"))
    best = per.agg(F.min_by(F.col(KEY), F.struct(-F.col("n"), F.col(KEY))).alias("t"),
                   F.max("n").alias("m"))
    return best.select(F.when(F.col("m") > 0, F.col("t")).otherwise(F.lit("—")).alias("most_flagged"))


def _first_last(p: DataFrame) -> DataFrame:
    return p.groupBy(KEY).agg(F.min_by("Close", TIME).alias("first_close"),
                              F.max_by("Close", TIME).alias("last_close"))


def normalised_price(p: DataFrame, n_series: int | None = None) -> DataFrame:
    """100 * Close / first Close per ticker; tickers with first Close 0 are skipped."""
    base = _first_last(p).filter(F.col("first_close") != 0)
    j = join_small(p, base, KEY, n_series)
    return j.select(KEY, TIME, (F.lit(100.0) * F.col("Close") / F.col("first_close")).alias("norm_price"),
                    "consensus_anomaly")


def normalised_markers(p: DataFrame, n_series: int | None = None) -> DataFrame:
    """Consensus rows on the normalised scale (base taken before filtering)."""
    return normalised_price(p, n_series).filter(F.col("consensus_anomaly") == 1)


def _pct_change(df: DataFrame, part: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(TIME)
    return df.withColumn("_chg", F.try_divide(F.col("Close"), F.lag("Close", 1).over(w)) - 1)


def portfolio_summary(p: DataFrame) -> DataFrame:
    """Per ticker period return %, daily vol % (sample std of pct change), flags, rate."""
    chg = over_series(p.select(KEY, TIME, "Close", "if_anomaly", "band_anomaly", "consensus_anomaly"),
                      _pct_change, halo=1)
    agg = chg.groupBy(KEY).agg(
        F.min_by("Close", TIME).alias("_first"), F.max_by("Close", TIME).alias("_last"),
        (F.stddev_samp("_chg") * 100).alias("daily_vol_pct"),
        F.sum("if_anomaly").cast("long").alias("n_if"),
        F.sum("band_anomaly").cast("long").alias("n_band"),
        F.sum("consensus_anomaly").cast("long").alias("n_consensus"),
        F.count(F.lit(1)).alias("n_days"))
    return agg.select(
        KEY, ((F.try_divide(F.col("_last"), F.col("_first")) - 1) * 100).alias("period_return_pct"),
        "daily_vol_pct", "n_if", "n_band", "n_consensus", "n_days",
        pct_of(F.col("n_consensus"), F.col("n_days")).alias("consensus_rate_pct"))


def summary_text(summary: DataFrame) -> DataFrame:
    """Display strings: return '+.1f%', vol '.2f%', rate '.2f%' (values rounded half away
    from zero first, so the text does not depend on the formatter's own rounding)."""
    return summary.select(
        KEY, F.format_string("%+.1f%%", round_half_away(F.col("period_return_pct"), 1)).alias("period_return"),
        F.format_string("%.2f%%", round_half_away(F.col("daily_vol_pct"), 2)).alias("daily_vol"),
        "n_if", "n_band", "n_consensus",
        F.format_string("%.2f%%", round_half_away(F.col("consensus_rate_pct"), 2)).alias("consensus_rate"))


def score_series(p: DataFrame) -> DataFrame:
    """(ticker, Date, if_score), sorted inside each partition (the stored table is range-partitioned by both)."""
    return p.select(KEY, TIME, "if_score").sortWithinPartitions(KEY, TIME)


def month_col() -> Column:
    return F.date_format(F.col(TIME), MONTH_FMT)


def monthly_consensus(p: DataFrame) -> DataFrame:
    """A10: consensus count per (month, ticker)."""
    return (p.groupBy(month_col().alias("month"), KEY)
            .agg(F.sum("consensus_anomaly").cast("long").alias("consensus_count")))


def reflag(results: DataFrame, ticker: str, threshold: float | Column,
           start: str | None = None, end: str | None = None) -> DataFrame:
    """One ticker, IF and consensus recomputed from a user threshold (no refit)."""
    t = port(results, start, end, [ticker])
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    t = t.withColumn("if_anomaly", (F.col("if_score") <= thr).cast("int"))
    both = (F.col("if_anomaly") == 1) & (F.col("band_anomaly") == 1)
    return t.withColumn("consensus_anomaly", F.coalesce(both, F.lit(False)).cast("int"))


def stored_thresholds(results: DataFrame, q: float = 0.02) -> DataFrame:
    """Per-ticker q-quantile of the stored scores (exact), compared as detection compares them."""
    return if_threshold(results, q)


def default_threshold(results: DataFrame, ticker: str, q: float = 0.02) -> Column:
    """Slider default: round(2nd percentile of the ticker's stored scores, 3), -0.6 if none."""
    thr = stored_thresholds(results.filter(F.col(KEY) == ticker), q)
    val = thr.agg(F.max(round_half_away(F.col("threshold"), 3)))
    return F.coalesce(val.scalar(), F.lit(-0.6))


def deep_kpis(t: DataFrame) -> DataFrame:
    """Counts, rates and period return for the re-flagged ticker."""
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")  # noqa: E731  (empty range -> 0)
    agg = t.agg(n.alias("n_days"), total("if_anomaly").alias("n_if"),
                total("band_anomaly").alias("n_band"),
                total("consensus_anomaly").alias("n_consensus"),
                F.min_by("Close", TIME).alias("_f"), F.max_by("Close", TIME).alias("_l"))
    return agg.select("n_days", "n_if", "n_band", "n_consensus",
                      pct_of(F.col("n_if"), F.col("n_days")).alias("pct_if"),
                      pct_of(F.col("n_consensus"), F.col("n_days")).alias("pct_consensus"),
                      ((F.try_divide(F.col("_l"), F.col("_f")) - 1) * 100).alias("period_return_pct"))


def deep_series(t: DataFrame) -> DataFrame:
    """Price, score and residual series with flag subsets and residual sign."""
    return t.select(KEY, TIME, "Close", "if_score", "residual", "if_anomaly", "band_anomaly",
                    "consensus_anomaly",
                    F.when(F.col("residual") < 0, F.lit("below")).otherwise(F.lit("above"))
                    .alias("residual_side"))


def top_anomalies(t: DataFrame, k: int = TOP_ANOMALIES) -> DataFrame:
    """Consensus rows by |if_score| descending (ties: earlier date first), top k."""
    rows = t.filter(F.col("consensus_anomaly") == 1).withColumn("severity", F.abs("if_score"))
    return (rows.orderBy(F.col("severity").desc(), F.col(TIME).asc()).limit(k)
            .select(KEY, TIME, "Close", "daily_return", "if_score", "residual", "volume_zscore",
                    "severity"))


def complete_dates(p: DataFrame, selection: Sequence[str]) -> DataFrame:
    """A15 (long form): mean score per (Date, ticker) on dates where every selected
    ticker has a value."""
    per = p.filter(F.col(KEY).isin(list(selection))).groupBy(TIME, KEY).agg(
        F.avg("if_score").alias("if_score"))
    k = len(set(selection))
    full = per.groupBy(TIME).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == k).select(TIME)
    return per.join(full, TIME, "left_semi")


def score_pivot(p: DataFrame, selection: Sequence[str]) -> DataFrame:
    """A15 (wide form): one column per selected ticker, complete dates only."""
    long = complete_dates(p, selection)
    return long.groupBy(TIME).pivot(KEY, sorted(set(selection))).agg(F.first("if_score"))


#: Selected tickers whose scores meet in one matrix product.
CORR_TILE = 256


def _tile_sums(k: int, tile: int):
    """For ``mapInArrow``: products of standardised scores, summed over the dates of a partition, for the pairs i < j of two tiles.

    Rows (p, q, Date, i, z) come sorted; complete dates have a row for every ticker of tiles p and q, so rows are a matrix."""
    def members(p: int) -> np.ndarray:
        return np.arange(p * tile, min(k, (p + 1) * tile))

    def told(p: int, q: int, total: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(members(p)[:, None] < members(q)[None, :])
        return pa.RecordBatch.from_arrays([pa.array(members(p)[i], pa.int32()), pa.array(members(q)[j], pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, rest = None, None, np.zeros(0)
        for batch in batches:
            p, q = (batch.column(c).to_numpy() for c in (0, 1))
            z = batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            for first, end in zip(np.append(0, edges), np.append(edges, len(p))):
                if end == first:
                    continue
                here = (int(p[first]), int(q[first]))
                left, right = members(here[0]), members(here[1])
                if here != now:
                    if now is not None:
                        yield told(*now, total)
                    now, total, rest = here, np.zeros((len(left), len(right))), np.zeros(0)
                width = len(left) if here[0] == here[1] else len(left) + len(right)
                values = np.concatenate([rest, z[first:end]])
                whole = len(values) // width * width
                dates, rest = values[:whole].reshape(-1, width), values[whole:]
                total += dates[:, :len(left)].T @ dates[:, -len(right):]
        if now is not None:
            yield told(*now, total)
    return run


def _pair_stats(long: DataFrame, selection: Sequence[str], tile: int = CORR_TILE) -> DataFrame:
    """Correlation of every pair a < b over complete dates, null where a score does not vary: the matrix of the selection, so its size is the selection's square.

    Scores are standardised and each goes to the products of its tile of tickers with every tile; partial matrices are summed by
    pair. Rows sent grow with dates x selection x number of tiles, and a partition gives out a pair once, however many dates it holds."""
    spark, sel = long.sparkSession, sorted(set(selection))
    tiles = -(-len(sel) // tile)
    # both tables are bounded by the selection, a list in the driver
    names = F.broadcast(spark.createDataFrame(list(enumerate(sel)), f"i int, {KEY} string"))
    spread = F.stddev_samp("if_score") * F.sqrt(F.count("if_score") - 1)
    stats = F.broadcast(long.groupBy(KEY).agg(F.avg("if_score").alias("_mean"), spread.alias("_spread")))
    z = F.coalesce(F.try_divide(F.col("if_score") - F.col("_mean"), F.col("_spread")), F.lit(float("nan")))
    own = F.floor(F.col("i") / tile).cast("int")
    rows = long.join(stats, KEY).join(names, KEY).select(TIME, "i", z.alias("z"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    rows = rows.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), TIME, "i", "z").repartition("p", "q", TIME)
    sums = rows.sortWithinPartitions("p", "q", TIME, "i").select("p", "q", "z").mapInArrow(_tile_sums(len(sel), tile), "i int, j int, s double")
    pairs = sums.groupBy("i", "j").agg(F.sum("s").alias("s"))
    second = names.select(F.col("i").alias("j"), F.col(KEY).alias("b"))
    named = pairs.join(names.select("i", F.col(KEY).alias("a")), "i").join(second, "j")
    return named.select("a", "b", F.when(~F.isnan("s"), F.col("s")).alias("corr"))


def score_corr(p: DataFrame, selection: Sequence[str]) -> DataFrame:
    """Pearson correlation of scores for every pair of selected tickers (rounded
    to 2), over complete dates; symmetric with unit diagonal; empty for one ticker."""
    sel = sorted(set(selection))
    if len(sel) < 2:
        return p.sparkSession.createDataFrame([], "a string, b string, corr double")
    long = complete_dates(p, sel)
    upper = _pair_stats(long, sel).withColumn("corr", round_half_away(F.col("corr"), 2))
    present = long.select(F.col(KEY).alias("a")).distinct()
    diag = present.select("a", F.col("a").alias("b"), F.lit(1.0).alias("corr"))
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return upper.unionByName(lower).unionByName(diag)


def pair_verdict(p: DataFrame, selection: Sequence[str], pairs: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Correlation of named pairs and whether it is above its cut-off."""
    long = complete_dates(p, selection)
    spark = p.sparkSession
    ptab = spark.createDataFrame([(a, b, float(c)) for a, b, c in pairs], "a string, b string, cut double")
    st = _pair_stats(long, selection)
    both = st.unionByName(st.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return (both.join(ptab, ["a", "b"])
            .select("a", "b", "corr", "cut",
                    F.when(F.col("corr") > F.col("cut"), F.lit("above")).otherwise(F.lit("below"))
                    .alias("verdict")))


def heatmap(p: DataFrame, selection: Sequence[str]) -> DataFrame:
    """A18 (long form): ticker x month consensus counts over all months present, 0 where
    a ticker has no flag that month, null (NaN in the reference) for a selected ticker
    without any rows. Each month present is given every selected ticker, then joined with the counts."""
    counts = monthly_consensus(p)
    grid = counts.select("month").distinct().withColumn(KEY, F.explode(F.array(*[F.lit(t) for t in selection])))
    there = counts.select(KEY).distinct().withColumn("_there", F.lit(True))
    full = grid.join(counts, ["month", KEY], "left").join(there, KEY, "left")
    count = F.coalesce(F.col("consensus_count").cast("double"), F.when(F.col("_there"), F.lit(0.0)))
    return full.select(KEY, "month", count.alias("consensus_count"))


def rolling_rate(p: DataFrame, bars: int = ROLLING_RATE_BARS) -> DataFrame:
    """Consensus rate (%) over the last ``bars`` rows per ticker, null until full."""
    def fn(df: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(TIME).rowsBetween(-(bars - 1), 0)
        c = F.col("consensus_anomaly")
        return df.withColumn("rolling_rate_pct", gated(F.avg(c), c, w, bars) * 100)
    return over_series(p.select(KEY, TIME, "consensus_anomaly"), fn, halo=bars - 1).select(
        KEY, TIME, "rolling_rate_pct")


DATA_VIEW_COLS = [KEY, "Close", "daily_return", "if_score", "residual", "if_anomaly", "band_anomaly",
                  "consensus_anomaly"]


def data_view(p: DataFrame, ticker: str | None = None, consensus_only: bool = False) -> DataFrame:
    """Optional ticker and consensus-only filters; the display columns present."""
    d = p
    if ticker is not None:
        d = d.filter(F.col(KEY) == ticker)
    if consensus_only:
        d = d.filter(F.col("consensus_anomaly") == 1)
    return d.select(TIME, *[c for c in DATA_VIEW_COLS if c in d.columns])


def export_csv(view: DataFrame, path: str) -> None:
    """Write the displayed columns (with Date) as CSV with a header."""
    view.write.mode("overwrite").option("header", True).csv(path)


def risk_tier(summary: DataFrame) -> DataFrame:
    """Elevated (rate > 5 % or vol > 2.5 %), moderate (rate > 2 %), else stable."""
    rate, vol = F.col("consensus_rate_pct"), F.col("daily_vol_pct")
    tier = (F.when((rate > 5) | (vol > 2.5), F.lit("elevated"))
            .when(rate > 2, F.lit("moderate")).otherwise(F.lit("stable")))
    return summary.select(KEY, "consensus_rate_pct", "daily_vol_pct", tier.alias("tier"))


def stress_months(p: DataFrame, min_tickers: int = 3) -> DataFrame:
    """Months in which at least ``min_tickers`` tickers have a consensus flag."""
    m = monthly_consensus(p).filter(F.col("consensus_count") > 0)
    return (m.groupBy("month").agg(F.count(F.lit(1)).alias("n_tickers"))
            .filter(F.col("n_tickers") >= min_tickers))


def agreement(p: DataFrame) -> DataFrame:
    """Model agreement per ticker = both / either flag (%), with its guide band."""
    either = ((F.col("if_anomaly") == 1) | (F.col("band_anomaly") == 1)).cast("int")
    agg = p.groupBy(KEY).agg(F.sum("consensus_anomaly").cast("long").alias("n_both"),
                             F.sum(either).cast("long").alias("n_either"))
    pct = F.lit(100.0) * F.try_divide(F.col("n_both"), F.col("n_either"))
    band = (F.when(pct > 60, F.lit("genuine stress")).when(pct >= 20, F.lit("different risks"))
            .otherwise(F.lit("needs tuning")))
    return agg.select(KEY, "n_both", "n_either", pct.alias("agreement_pct"), band.alias("guide"))


def ticker_labels(results: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Display label from the table of known labels, else the ticker itself."""
    spark = results.sparkSession
    labels = spark.createDataFrame(list((known or TICKER_LABELS).items()), "ticker string, label string")
    t = results.select(KEY).distinct()
    return t.join(labels, KEY, "left").select(KEY, F.coalesce("label", KEY).alias("label"))
