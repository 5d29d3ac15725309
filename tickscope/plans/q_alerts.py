"""Registered queries: live scoring with stored models, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import live as L
from ..operators.portfolio import stored_thresholds
from . import oracle as O
from .fixtures import daily_bars, daily_models, daily_results
from .registry import register

D = O.detect(O.bars_daily())
REQUESTED = ["A", "N", "R", "X"]
SAVED_LOOKBACK = 90
AUTO_LOOKBACK = 30


def _live_ctes(min_bars: int, thresholds: str = "thresholds") -> list[str]:
    guard = (f'WHERE ticker IN (SELECT ticker FROM rb GROUP BY ticker HAVING count(*) >= {min_bars})'
             if min_bars > 0 else "")
    return [
        """rb AS (SELECT * FROM bars WHERE "Date" > (SELECT max("Date") FROM bars) - INTERVAL 90 DAY
                 AND "Date" <= (SELECT max("Date") FROM bars))""",
        f"rb2 AS (SELECT * FROM rb {guard})",
        *O.features("rb2", "rf"), *O.scaled("rf", "scaler", "rs"), *O.score("rs", "fo", "ls"),
        f"""live AS (
  SELECT s.ticker, max(s."Date") AS date, arg_max(f."Close", s."Date") AS close, arg_max(s.if_score, s."Date") AS if_score,
         coalesce(any_value(t.threshold), -0.6) AS threshold,
         coalesce(round(arg_max(s.if_score, s."Date"), 9) <= coalesce(any_value(t.threshold), -0.6), false) AS anomaly,
         arg_max(f.daily_return, s."Date") AS daily_ret, arg_max(f.volume_zscore, s."Date") AS vol_z
  FROM ls s JOIN rf f USING (ticker, "Date") LEFT JOIN {thresholds} t USING (ticker) GROUP BY s.ticker)""",
    ]


#: A threshold quantile at which the latest bars of the fixture are flagged, so the live alerts are not empty.
SENSITIVE = 0.995
SENSITIVE_CTE = f"""sensitive AS (SELECT ticker, quantile_cont(round(if_score, 9), {SENSITIVE}) AS threshold FROM results GROUP BY ticker)"""
LIVE_D = [*D, SENSITIVE_CTE, *_live_ctes(0, "sensitive")]


def _live(spark, sf, min_bars=60, q=0.02):
    models = daily_models(spark, sf)
    thr = stored_thresholds(daily_results(spark, sf), q)
    return L.live_scores(daily_bars(spark, sf), models.scaler, models.forest, thr, min_bars=min_bars)


@register("live_scores", L.LIVE_COLS, ["close", "if_score", "threshold", "daily_ret", "vol_z"],
          O.with_([*D, *_live_ctes(60)], "SELECT * FROM live"))
def q_live_scores(spark, sf):
    return _live(spark, sf)


@register("live_summary", ["n_scored", "n_anomalies"], [], O.with_(LIVE_D, """
SELECT count(*) AS n_scored, CAST(coalesce(sum(CAST(anomaly AS INTEGER)), 0) AS BIGINT) AS n_anomalies FROM live"""))
def q_live_summary(spark, sf):
    return L.live_summary(_live(spark, sf, 0, SENSITIVE))


@register("live_anomalous", ["ticker"], [], O.with_(LIVE_D, "SELECT ticker FROM live WHERE anomaly"))
def q_live_anomalous(spark, sf):
    return L.anomalous_tickers(_live(spark, sf, 0, SENSITIVE))


@register("missing_models", ["ticker"], [], O.with_(D, """
SELECT r.ticker FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS r(ticker)
WHERE r.ticker NOT IN (SELECT DISTINCT ticker FROM fo_l0)"""))
def q_missing_models(spark, sf):
    return L.missing_models(spark, daily_models(spark, sf).forest, REQUESTED)


SAVED_SQL = f"""
SELECT ticker, "Date", "Close", if_score, residual, 'consensus' AS source FROM results
WHERE "Date" >= CAST(CAST((SELECT max("Date") FROM results) AS DATE) - INTERVAL {SAVED_LOOKBACK} DAY AS TIMESTAMP)
  AND consensus_anomaly = 1"""


def _saved(spark, sf, lookback=SAVED_LOOKBACK):
    r = daily_results(spark, sf)
    return A.alerts_saved(r, r.agg(F.max("Date")).scalar(), lookback)


@register("alerts_saved", A.ALERT_COLS, ["Close", "if_score", "residual"], O.with_(D, SAVED_SQL))
def q_alerts_saved(spark, sf):
    return _saved(spark, sf)


LIVE_ALERTS_SQL = """SELECT ticker, date AS "Date", close AS "Close", if_score, CAST(0.0 AS DOUBLE) AS residual,
       'live_IF_only' AS source FROM live WHERE anomaly"""


@register("alerts_live", A.ALERT_COLS, ["Close", "if_score", "residual"], O.with_(LIVE_D, LIVE_ALERTS_SQL))
def q_alerts_live(spark, sf):
    return A.alerts_live(_live(spark, sf, 0, SENSITIVE))


AUTO_SQL = f"""
SELECT ticker, "Date", "Close", if_score, residual, 'consensus' AS source FROM results
WHERE "Date" >= CAST(CAST((SELECT max("Date") FROM results) AS DATE) - INTERVAL {AUTO_LOOKBACK} DAY AS TIMESTAMP)
  AND consensus_anomaly = 1"""
#: Days after the last stored bar at which the stored results are stale.
STALE_DAYS = 400


def _auto(spark, sf, days_later=0, force_live=False):
    r = daily_results(spark, sf)
    as_of = (r.agg(F.max("Date")).scalar() + F.make_interval(days=F.lit(days_later)))
    return A.alerts_auto(r, lambda: _live(spark, sf, 0, SENSITIVE), as_of, AUTO_LOOKBACK, force_live)


@register("alerts_auto", A.ALERT_COLS, ["Close", "if_score", "residual"], O.with_(D, AUTO_SQL))
def q_alerts_auto(spark, sf):
    """Fresh results: the saved consensus rows."""
    return _auto(spark, sf)


@register("alerts_auto_stale", A.ALERT_COLS, ["Close", "if_score", "residual"], O.with_(LIVE_D, LIVE_ALERTS_SQL))
def q_alerts_auto_stale(spark, sf):
    """Stale results: the live rows."""
    return _auto(spark, sf, STALE_DAYS)


@register("alerts_auto_forced", A.ALERT_COLS, ["Close", "if_score", "residual"], O.with_(LIVE_D, LIVE_ALERTS_SQL))
def q_alerts_auto_forced(spark, sf):
    """Live rows although the results are fresh."""
    return _auto(spark, sf, force_live=True)


ROWS_SQL = f"""
SELECT ticker, "Date", source, CASE WHEN coalesce(residual, 0.0) < 0 THEN 'Below trend' ELSE 'Above trend' END AS direction,
       strftime("Date", '%b %d, %Y') AS date_text, printf('$%.2f', round("Close", 2)) AS close_text,
       printf('%.4f', round(if_score, 4)) AS score_text FROM ({SAVED_SQL})"""


@register("alert_rows", [A.KEY, A.TIME, "source", "direction", "date_text", "close_text", "score_text"], [],
          O.with_(D, ROWS_SQL))
def q_alert_rows(spark, sf):
    return A.alert_rows(_saved(spark, sf))


DIGEST_TICKER = "A"
DIGEST_SQL = f"""SELECT ticker, 'consensus' AS source FROM results WHERE ticker = '{DIGEST_TICKER}' AND consensus_anomaly = 1"""


@register("alert_digest", ["n_tickers", "n_consensus", "n_live", "tag"], [], O.with_(LIVE_D, f"""
SELECT n_tickers, n_consensus, n_tickers - n_consensus AS n_live,
       CASE WHEN n_consensus > 0 AND n_tickers - n_consensus = 0 THEN 'consensus'
            WHEN n_consensus = 0 THEN 'IF only' ELSE 'mixed' END AS tag FROM (
  SELECT count(*) AS n_tickers, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_consensus FROM (
    SELECT ticker, max(CAST(source <> 'live_IF_only' AS INTEGER)) AS c FROM (
      {DIGEST_SQL} UNION ALL SELECT ticker, source FROM ({LIVE_ALERTS_SQL})) GROUP BY ticker))"""))
def q_alert_digest(spark, sf):
    """Saved rows of one ticker over its whole history, live rows of all: a mixed digest."""
    r = daily_results(spark, sf)
    saved = A.alerts_saved(r.filter(F.col("ticker") == DIGEST_TICKER), r.agg(F.max("Date")).scalar(), 100_000)
    return A.alert_digest(saved.unionByName(A.alerts_live(_live(spark, sf, 0, SENSITIVE))))


@register("alert_digest_saved", ["n_tickers", "n_consensus", "n_live", "tag"], [], O.with_(D, """
SELECT count(DISTINCT ticker) AS n_tickers, count(DISTINCT ticker) AS n_consensus, CAST(0 AS BIGINT) AS n_live,
       CASE WHEN count(*) > 0 THEN 'consensus' ELSE 'IF only' END AS tag FROM results WHERE consensus_anomaly = 1"""))
def q_alert_digest_saved(spark, sf):
    r = daily_results(spark, sf)
    return A.alert_digest(A.alerts_saved(r, r.agg(F.max("Date")).scalar(), 100_000))
