"""Registered queries: portfolio analytics over the daily detection results."""

from __future__ import annotations


from ..operators import portfolio as P
from ..operators.windows import series_stats
from . import oracle as O
from .fixtures import daily_results
from .registry import register

D = O.detect(O.bars_daily())
SEL = ["A", "N", "R"]            # selection: every ticker of the daily fixture
SEL_WITH_MISSING = ["A", "N", "R", "X"]
FOCUS = "A"                      # single-ticker focus: first of the sorted selection
RANGE = ("1996-01-01", "1999-12-31")
PAIRS = [("A", "N", 0.8), ("A", "R", 0.3)]
H = "CAST(100.0 AS DOUBLE)"


def sql(body: str, extra: list[str] | None = None) -> str:
    return O.with_([*D, *(extra or [])], body)


def _res(spark, sf):
    return daily_results(spark, sf)


@register("portfolio", ["ticker", "Date", "Close", "if_score", "if_anomaly", "band_anomaly",
                        "consensus_anomaly"], ["Close", "if_score"],
          sql('SELECT ticker, "Date", "Close", if_score, if_anomaly, band_anomaly, consensus_anomaly FROM results'))
def q_portfolio(spark, sf):
    return _res(spark, sf)


@register("portfolio_filter", ["ticker", "Date", "Close", "if_score", "consensus_anomaly"],
          ["Close", "if_score"],
          sql(f"""SELECT ticker, "Date", "Close", if_score, consensus_anomaly FROM results
WHERE CAST("Date" AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' AND ticker IN ('A', 'R')"""))
def q_portfolio_filter(spark, sf):
    return P.port(_res(spark, sf), RANGE[0], RANGE[1], ["A", "R"])


@register("tickers", ["ticker"], [], sql("SELECT DISTINCT ticker FROM results"))
def q_tickers(spark, sf):
    return P.tickers(_res(spark, sf))


@register("extent", ["first_date", "last_date", "n_rows"], [],
          sql('SELECT min("Date") AS first_date, max("Date") AS last_date, count(*) AS n_rows FROM results'))
def q_extent(spark, sf):
    return P.extent(_res(spark, sf))


KPI_COLS = ["total_rows", "total_if", "total_band", "total_consensus", "pct_if", "pct_band", "pct_consensus"]


KPI_SQL = f"""
SELECT *, {H} * total_if / greatest(total_rows, 1) AS pct_if, {H} * total_band / greatest(total_rows, 1) AS pct_band,
       {H} * total_consensus / greatest(total_rows, 1) AS pct_consensus FROM (
  SELECT count(*) AS total_rows, CAST(coalesce(sum(if_anomaly), 0) AS BIGINT) AS total_if,
         CAST(coalesce(sum(band_anomaly), 0) AS BIGINT) AS total_band,
         CAST(coalesce(sum(consensus_anomaly), 0) AS BIGINT) AS total_consensus FROM results)"""


@register("kpis", KPI_COLS, ["pct_if", "pct_band", "pct_consensus"], sql(KPI_SQL))
def q_kpis(spark, sf):
    return P.kpis(_res(spark, sf))


@register("most_flagged", ["most_flagged"], [], sql("""
SELECT CASE WHEN max(n) > 0 THEN arg_min(ticker, (-n, ticker)) ELSE '—' END AS most_flagged FROM (
  SELECT ticker, sum(consensus_anomaly) AS n FROM results GROUP BY ticker)"""))
def q_most_flagged(spark, sf):
    return P.most_flagged(_res(spark, sf))


NORM_SQL = f"""
SELECT r.ticker, r."Date", {H} * r."Close" / b.fc AS norm_price, r.consensus_anomaly
FROM results r JOIN (SELECT ticker, arg_min("Close", "Date") AS fc FROM results GROUP BY ticker) b USING (ticker)
WHERE b.fc <> 0"""


@register("normalised_price", ["ticker", "Date", "norm_price"], ["norm_price"],
          sql(f"SELECT ticker, \"Date\", norm_price FROM ({NORM_SQL})"))
def q_normalised_price(spark, sf):
    r = _res(spark, sf)
    return P.normalised_price(r, series_stats(r).n_series)


@register("normalised_markers", ["ticker", "Date", "norm_price"], ["norm_price"],
          sql(f"SELECT ticker, \"Date\", norm_price FROM ({NORM_SQL}) WHERE consensus_anomaly = 1"))
def q_normalised_markers(spark, sf):
    r = _res(spark, sf)
    return P.normalised_markers(r, series_stats(r).n_series)


SUMMARY_COLS = ["ticker", "period_return_pct", "daily_vol_pct", "n_if", "n_band", "n_consensus", "n_days",
                "consensus_rate_pct"]
SUMMARY_SQL = f"""
SELECT ticker, (arg_max("Close", "Date") / nullif(arg_min("Close", "Date"), 0) - 1) * 100 AS period_return_pct,
       stddev_samp(_chg) * 100 AS daily_vol_pct, CAST(sum(if_anomaly) AS BIGINT) AS n_if,
       CAST(sum(band_anomaly) AS BIGINT) AS n_band, CAST(sum(consensus_anomaly) AS BIGINT) AS n_consensus,
       count(*) AS n_days, {H} * sum(consensus_anomaly) / greatest(count(*), 1) AS consensus_rate_pct
FROM (SELECT *, "Close" / nullif(lag("Close") OVER (PARTITION BY ticker ORDER BY "Date"), 0) - 1 AS _chg FROM results)
GROUP BY ticker"""


@register("portfolio_summary", SUMMARY_COLS, ["period_return_pct", "daily_vol_pct", "consensus_rate_pct"],
          sql(SUMMARY_SQL))
def q_portfolio_summary(spark, sf):
    return P.portfolio_summary(_res(spark, sf))


@register("score_series", ["ticker", "Date", "if_score"], ["if_score"],
          sql('SELECT ticker, "Date", if_score FROM results'))
def q_score_series(spark, sf):
    return P.score_series(_res(spark, sf))


MONTHLY_SQL = """SELECT strftime("Date", '%Y-%m') AS month, ticker, CAST(sum(consensus_anomaly) AS BIGINT) AS consensus_count
FROM results GROUP BY 1, 2"""


@register("monthly_consensus", ["month", "ticker", "consensus_count"], [], sql(MONTHLY_SQL))
def q_monthly_consensus(spark, sf):
    return P.monthly_consensus(_res(spark, sf))


REFLAG_THR = f"""(SELECT coalesce(max(round(t, 3)), -0.6) FROM (
  SELECT quantile_cont(if_score, 0.02) AS t FROM results WHERE ticker = '{FOCUS}'))"""
REFLAG_SQL = f"""
SELECT *, CAST(coalesce(if_anomaly = 1 AND band_anomaly = 1, false) AS INTEGER) AS consensus_anomaly FROM (
  SELECT * EXCLUDE (if_anomaly, consensus_anomaly), CAST(if_score <= {REFLAG_THR} AS INTEGER) AS if_anomaly
  FROM results WHERE ticker = '{FOCUS}')"""


def _reflagged(spark, sf):
    r = _res(spark, sf)
    return P.reflag(r, FOCUS, P.default_threshold(r, FOCUS))


@register("reflag", ["ticker", "Date", "Close", "if_score", "if_anomaly", "band_anomaly", "consensus_anomaly"],
          ["Close", "if_score"], sql(f'SELECT ticker, "Date", "Close", if_score, if_anomaly, band_anomaly, consensus_anomaly FROM ({REFLAG_SQL})'))
def q_reflag(spark, sf):
    return _reflagged(spark, sf)


@register("deep_kpis", ["n_days", "n_if", "n_band", "n_consensus", "pct_if", "pct_consensus", "period_return_pct"],
          ["pct_if", "pct_consensus", "period_return_pct"], sql(f"""
SELECT count(*) AS n_days, CAST(coalesce(sum(if_anomaly), 0) AS BIGINT) AS n_if,
       CAST(coalesce(sum(band_anomaly), 0) AS BIGINT) AS n_band,
       CAST(coalesce(sum(consensus_anomaly), 0) AS BIGINT) AS n_consensus,
       {H} * sum(if_anomaly) / greatest(count(*), 1) AS pct_if,
       {H} * sum(consensus_anomaly) / greatest(count(*), 1) AS pct_consensus,
       (arg_max("Close", "Date") / nullif(arg_min("Close", "Date"), 0) - 1) * 100 AS period_return_pct
FROM ({REFLAG_SQL})"""))
def q_deep_kpis(spark, sf):
    return P.deep_kpis(_reflagged(spark, sf))


@register("deep_series", ["ticker", "Date", "Close", "if_score", "residual", "if_anomaly", "band_anomaly",
                          "consensus_anomaly", "residual_side"], ["Close", "if_score", "residual"], sql(f"""
SELECT ticker, "Date", "Close", if_score, residual, if_anomaly, band_anomaly, consensus_anomaly,
       CASE WHEN residual < 0 THEN 'below' ELSE 'above' END AS residual_side FROM ({REFLAG_SQL})"""))
def q_deep_series(spark, sf):
    return P.deep_series(_reflagged(spark, sf))


@register("top_anomalies", ["ticker", "Date", "Close", "daily_return", "if_score", "residual", "volume_zscore",
                            "severity"], ["Close", "daily_return", "if_score", "residual", "volume_zscore", "severity"],
          sql(f"""
SELECT ticker, "Date", "Close", daily_return, if_score, residual, volume_zscore, abs(if_score) AS severity
FROM ({REFLAG_SQL}) WHERE consensus_anomaly = 1 ORDER BY abs(if_score) DESC, "Date" ASC LIMIT 15"""))
def q_top_anomalies(spark, sf):
    return P.top_anomalies(_reflagged(spark, sf))


def _complete_sql(sel: list[str]) -> str:
    lst = ", ".join(f"'{t}'" for t in sel)
    return f"""complete AS (
  SELECT "Date", ticker, avg(if_score) AS if_score FROM results WHERE ticker IN ({lst}) GROUP BY 1, 2
  QUALIFY count(*) OVER (PARTITION BY "Date") = {len(set(sel))})"""


@register("score_pivot", ["Date", "ticker", "if_score"], ["if_score"],
          sql('SELECT "Date", ticker, if_score FROM complete', [_complete_sql(SEL)]))
def q_score_pivot(spark, sf):
    return P.complete_dates(_res(spark, sf), SEL)


CORR_SQL = """
SELECT a, b, round(covar_samp(sa, sb) / nullif(stddev_samp(sa) * stddev_samp(sb), 0), 2) AS corr FROM (
  SELECT x.ticker AS a, y.ticker AS b, x.if_score AS sa, y.if_score AS sb
  FROM complete x JOIN complete y ON x."Date" = y."Date" AND x.ticker < y.ticker) GROUP BY a, b"""


@register("score_corr", ["a", "b", "corr"], ["corr"], sql("""
SELECT a, b, corr FROM up UNION ALL SELECT b AS a, a AS b, corr FROM up
UNION ALL SELECT DISTINCT ticker AS a, ticker AS b, 1.0 AS corr FROM complete""",
                                                         [_complete_sql(SEL), f"up AS ({CORR_SQL})"]))
def q_score_corr(spark, sf):
    return P.score_corr(_res(spark, sf), SEL)


@register("pair_verdict", ["a", "b", "corr", "cut", "verdict"], ["corr", "cut"], sql("""
SELECT s.a, s.b, s.corr, p.cut, CASE WHEN s.corr > p.cut THEN 'above' ELSE 'below' END AS verdict
FROM (SELECT x.ticker AS a, y.ticker AS b,
             covar_samp(x.if_score, y.if_score) / nullif(stddev_samp(x.if_score) * stddev_samp(y.if_score), 0) AS corr
      FROM complete x JOIN complete y ON x."Date" = y."Date" GROUP BY 1, 2) s
JOIN (VALUES ('A', 'N', CAST(0.8 AS DOUBLE)), ('A', 'R', CAST(0.3 AS DOUBLE))) AS p(a, b, cut) ON s.a = p.a AND s.b = p.b""", [_complete_sql(SEL)]))
def q_pair_verdict(spark, sf):
    return P.pair_verdict(_res(spark, sf), SEL, PAIRS)


@register("heatmap", ["ticker", "month", "consensus_count"], ["consensus_count"], sql("""
SELECT s.ticker, m.month, CASE WHEN s.ticker IN (SELECT ticker FROM counts) THEN CAST(coalesce(c.consensus_count, 0) AS DOUBLE) END AS consensus_count
FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS s(ticker) CROSS JOIN (SELECT DISTINCT month FROM counts) m
LEFT JOIN counts c ON c.ticker = s.ticker AND c.month = m.month""", [f"counts AS ({MONTHLY_SQL})"]))
def q_heatmap(spark, sf):
    r = _res(spark, sf)
    return P.heatmap(P.port(r, tickers=SEL_WITH_MISSING), SEL_WITH_MISSING)


ROLLING_SQL = """
SELECT ticker, "Date", CASE WHEN count(consensus_anomaly) OVER w = 30 THEN avg(consensus_anomaly) OVER w END * 100 AS rolling_rate_pct
FROM results WINDOW w AS (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


@register("rolling_rate", ["ticker", "Date", "rolling_rate_pct"], ["rolling_rate_pct"], sql(ROLLING_SQL))
def q_rolling_rate(spark, sf):
    return P.rolling_rate(_res(spark, sf))


@register("data_view", ["Date", *P.DATA_VIEW_COLS], ["Close", "daily_return", "if_score", "residual"], sql(f"""
SELECT "Date", {', '.join('"' + c + '"' for c in P.DATA_VIEW_COLS)} FROM results WHERE ticker = 'N'"""))
def q_data_view(spark, sf):
    return P.data_view(_res(spark, sf), ticker="N")


@register("data_view_consensus", ["Date", *P.DATA_VIEW_COLS], ["Close", "daily_return", "if_score", "residual"],
          sql(f"""SELECT "Date", {', '.join('"' + c + '"' for c in P.DATA_VIEW_COLS)} FROM results WHERE consensus_anomaly = 1"""))
def q_data_view_consensus(spark, sf):
    return P.data_view(_res(spark, sf), consensus_only=True)


@register("risk_tier", ["ticker", "consensus_rate_pct", "daily_vol_pct", "tier"],
          ["consensus_rate_pct", "daily_vol_pct"], sql(f"""
SELECT ticker, consensus_rate_pct, daily_vol_pct,
       CASE WHEN consensus_rate_pct > 5 OR daily_vol_pct > 2.5 THEN 'elevated'
            WHEN consensus_rate_pct > 2 THEN 'moderate' ELSE 'stable' END AS tier FROM ({SUMMARY_SQL})"""))
def q_risk_tier(spark, sf):
    return P.risk_tier(P.portfolio_summary(_res(spark, sf)))


@register("stress_months", ["month", "n_tickers"], [], sql(f"""
SELECT month, count(*) AS n_tickers FROM ({MONTHLY_SQL}) WHERE consensus_count > 0 GROUP BY month HAVING count(*) >= 3"""))
def q_stress_months(spark, sf):
    return P.stress_months(_res(spark, sf))


@register("agreement", ["ticker", "n_both", "n_either", "agreement_pct", "guide"], ["agreement_pct"], sql(f"""
SELECT *, CASE WHEN agreement_pct > 60 THEN 'genuine stress' WHEN agreement_pct >= 20 THEN 'different risks'
               ELSE 'needs tuning' END AS guide FROM (
  SELECT ticker, n_both, n_either, {H} * n_both / nullif(n_either, 0) AS agreement_pct FROM (
    SELECT ticker, CAST(sum(consensus_anomaly) AS BIGINT) AS n_both,
           CAST(sum(CAST(if_anomaly = 1 OR band_anomaly = 1 AS INTEGER)) AS BIGINT) AS n_either
    FROM results GROUP BY ticker))"""))
def q_agreement(spark, sf):
    return P.agreement(_res(spark, sf))


LABELS = {"A": "A — Accepted", "R": "R — Returned"}


@register("ticker_labels", ["ticker", "label"], [], sql("""
SELECT DISTINCT ticker, CASE ticker WHEN 'A' THEN 'A — Accepted' WHEN 'R' THEN 'R — Returned' ELSE ticker END AS label FROM results"""))
def q_ticker_labels(spark, sf):
    return P.ticker_labels(_res(spark, sf), LABELS)


# --- the same over a date range: lags, rolling windows and bases start anew at its first bar

def _range_sql(body: str) -> str:
    cut = f"""ranged AS (SELECT * FROM results WHERE CAST("Date" AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}')"""
    return sql(body.replace("FROM results", "FROM ranged"), [cut])


def _ranged(spark, sf):
    return P.port(_res(spark, sf), *RANGE)


@register("portfolio_summary_range", SUMMARY_COLS, ["period_return_pct", "daily_vol_pct", "consensus_rate_pct"], _range_sql(SUMMARY_SQL))
def q_portfolio_summary_range(spark, sf):
    return P.portfolio_summary(_ranged(spark, sf))


@register("normalised_price_range", ["ticker", "Date", "norm_price"], ["norm_price"],
          _range_sql(f"SELECT ticker, \"Date\", norm_price FROM ({NORM_SQL})"))
def q_normalised_price_range(spark, sf):
    return P.normalised_price(_ranged(spark, sf))


@register("rolling_rate_range", ["ticker", "Date", "rolling_rate_pct"], ["rolling_rate_pct"], _range_sql(ROLLING_SQL))
def q_rolling_rate_range(spark, sf):
    return P.rolling_rate(_ranged(spark, sf))


@register("kpis_range", KPI_COLS, ["pct_if", "pct_band", "pct_consensus"], _range_sql(KPI_SQL))
def q_kpis_range(spark, sf):
    return P.kpis(_ranged(spark, sf))


@register("heatmap_range", ["ticker", "month", "consensus_count"], ["consensus_count"], _range_sql(f"""
SELECT s.ticker, m.month, CAST(coalesce(c.n, 0) AS DOUBLE) AS consensus_count
FROM (VALUES ('A'), ('N'), ('R')) AS s(ticker) CROSS JOIN (SELECT DISTINCT strftime("Date", '%Y-%m') AS month FROM results) m
LEFT JOIN (SELECT ticker, strftime("Date", '%Y-%m') AS month, sum(consensus_anomaly) AS n FROM results GROUP BY 1, 2) c USING (ticker, month)"""))
def q_heatmap_range(spark, sf):
    return P.heatmap(_ranged(spark, sf), SEL)


@register("score_pivot_wide", ["Date", *SEL], SEL, sql("""
SELECT "Date", max(if_score) FILTER (ticker = 'A') AS "A", max(if_score) FILTER (ticker = 'N') AS "N", max(if_score) FILTER (ticker = 'R') AS "R"
FROM complete GROUP BY 1""", [_complete_sql(SEL)]))
def q_score_pivot_wide(spark, sf):
    return P.score_pivot(_res(spark, sf), SEL)


@register("portfolio_summary_text", ["ticker", "period_return", "daily_vol", "n_if", "n_band", "n_consensus",
                                     "consensus_rate"], [], sql(f"""
SELECT ticker, printf('%+.1f%%', round(period_return_pct, 1)) AS period_return,
       printf('%.2f%%', round(daily_vol_pct, 2)) AS daily_vol, n_if, n_band, n_consensus,
       printf('%.2f%%', round(consensus_rate_pct, 2)) AS consensus_rate FROM ({SUMMARY_SQL})"""))
def q_portfolio_summary_text(spark, sf):
    return P.summary_text(P.portfolio_summary(_res(spark, sf)))
