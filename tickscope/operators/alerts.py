"""Alerts: saved-consensus rows, live IF-only rows, automatic mode, presentation, digest.

``as_of`` is always a parameter (a literal or a scalar column), never the wall clock
inside the plan, so a run is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round_half_away
from ..schemas import CONSENSUS_SOURCE, KEY, LIVE_SOURCE, TIME

ALERT_COLS = [KEY, TIME, "Close", "if_score", "residual", "source"]


def _as_col(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def cutoff(as_of, lookback_days: int) -> Column:
    """Midnight of (as_of - lookback days)."""
    day = F.date_sub(F.to_date(_as_col(as_of)), lookback_days)
    return day.cast("timestamp_ntz")


def alerts_saved(results: DataFrame, as_of, lookback_days: int = 1) -> DataFrame:
    """L1: consensus rows on or after the cutoff."""
    rows = results.filter((F.col(TIME) >= cutoff(as_of, lookback_days)) & (F.col("consensus_anomaly") == 1))
    return rows.select(KEY, TIME, "Close", "if_score", "residual", F.lit(CONSENSUS_SOURCE).alias("source"))


def alerts_live(live: DataFrame) -> DataFrame:
    """L2: latest bars flagged by the IF alone; no band is run live (residual 0.0)."""
    rows = live.filter(F.col("anomaly"))
    return rows.select(KEY, F.col("date").alias(TIME), F.col("close").alias("Close"), "if_score",
                       F.lit(0.0).alias("residual"), F.lit(LIVE_SOURCE).alias("source"))


def results_fresh(results: DataFrame, as_of, lookback_days: int) -> Column:
    """Portfolio-wide freshness: latest stored date on or after the cutoff (scalar)."""
    last = results.agg(F.max(TIME)).scalar()
    return F.coalesce(last >= cutoff(as_of, lookback_days), F.lit(False))


def alerts_auto(results: DataFrame, live, as_of, lookback_days: int = 1,
                force_live: bool = False) -> DataFrame:
    """L3: live when forced or when stored results are stale, else saved consensus.

    ``live`` is a DataFrame or a zero-argument callable building one; the one-row
    freshness flag is evaluated first so only the chosen branch is ever planned
    and run (the live branch re-scores recent bars)."""
    def live_df() -> DataFrame:
        return live() if callable(live) else live
    if force_live:
        return alerts_live(live_df())
    fresh = results.select(results_fresh(results, as_of, lookback_days).alias("f")).limit(1).first()
    if fresh is not None and fresh["f"]:
        return alerts_saved(results, as_of, lookback_days)
    return alerts_live(live_df())


def alert_rows(alerts: DataFrame) -> DataFrame:
    """L4: presentation fields (source default, trend direction, formatted text)."""
    source = F.coalesce(F.col("source"), F.lit(CONSENSUS_SOURCE))
    direction = F.when(F.coalesce(F.col("residual"), F.lit(0.0)) < 0, F.lit("Below trend")) \
        .otherwise(F.lit("Above trend"))
    return alerts.select(
        KEY, TIME, source.alias("source"), direction.alias("direction"),
        F.date_format(TIME, "MMM dd, yyyy").alias("date_text"),
        F.format_string("$%.2f", round_half_away(F.col("Close"), 2)).alias("close_text"),
        F.format_string("%.4f", round_half_away(F.col("if_score"), 4)).alias("score_text"))


def alert_digest(alerts: DataFrame) -> DataFrame:
    """Number of flagged tickers and the subject tag (consensus / IF only / mixed)."""
    per = alerts.groupBy(KEY).agg(
        F.max((F.coalesce(F.col("source"), F.lit(CONSENSUS_SOURCE)) != LIVE_SOURCE).cast("int")).alias("_c"))
    agg = per.agg(F.count(F.lit(1)).alias("n_tickers"),
                  F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_consensus"))
    n_live = F.col("n_tickers") - F.col("n_consensus")
    tag = (F.when((F.col("n_consensus") > 0) & (n_live == 0), F.lit("consensus"))
           .when(F.col("n_consensus") == 0, F.lit("IF only")).otherwise(F.lit("mixed")))
    return agg.select("n_tickers", "n_consensus", n_live.alias("n_live"), tag.alias("tag"))


def anything_to_send(alerts: DataFrame) -> bool:
    """One action; an empty alert set sends nothing."""
    return not alerts.isEmpty()
