"""Registered queries: streaming bars and streaming live scoring (AvailableNow runs)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import live as L
from ..operators.portfolio import stored_thresholds
from ..session import scratch_path
from ..streaming.bars_stream import run_bars_available_now
from ..streaming.live_stream import latest_per_ticker, latest_scores, read_bar_stream, start_live_scoring
from . import oracle as O
from .fixtures import daily_bars, daily_models, daily_results
from .registry import register

BAR_COLS = ["ticker", "Date", "Open", "High", "Low", "Close", "Volume"]


@register("stream_bars", BAR_COLS, ["Open", "High", "Low", "Close", "Volume"], O.with_(O.bars_events(), """
SELECT * FROM bars WHERE "Date" + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""))
def q_stream_bars(spark, sf):
    run = uuid.uuid4().hex[:12]
    return run_bars_available_now(spark, sf, scratch_path(spark, "stream_bars", run, "out"),
                                  scratch_path(spark, "stream_bars", run, "ckpt"), glob="events.parquet")


STREAM_FILES = 4


def _arrivals(spark, sf) -> DataFrame:
    """The stream of the daily bars, that arrive in STREAM_FILES folders one after the other, each a stretch of time."""
    bars, run = daily_bars(spark, sf), scratch_path(spark, "stream_src", uuid.uuid4().hex[:12])
    day = F.unix_date(F.to_date("Date"))
    first, last = bars.agg(F.min(day)).scalar(), bars.agg(F.max(day)).scalar()
    numbered = bars.withColumn("_at", F.floor((day - first) * STREAM_FILES / (last - first + 1)))
    for k in range(STREAM_FILES):
        numbered.filter(F.col("_at") == k).drop("_at").repartitionByRange("ticker", "Date").write.parquet(f"{run}/arrival={k}")
    files = len(spark.read.parquet(run).inputFiles())
    return read_bar_stream(spark, run, max_files=-(-files // STREAM_FILES))


STREAM_COLS = ["ticker", "Date", "Close", "if_score", "threshold", "if_anomaly", "daily_return", "volume_zscore"]
STREAM_DOUBLES = ["Close", "if_score", "threshold", "daily_return", "volume_zscore"]
STREAM_SQL = O.with_(O.detect(O.bars_daily()), """
SELECT r.ticker, r."Date", r."Close", r.if_score, t.threshold, r.if_anomaly, r.daily_return, r.volume_zscore
FROM results r JOIN thresholds t USING (ticker)""")


@register("stream_live", STREAM_COLS, STREAM_DOUBLES, STREAM_SQL)
def q_stream_live(spark, sf):
    """Bars arrive file by file from an empty history; every bar's newest score equals the batch run's."""
    models = daily_models(spark, sf)
    thr = stored_thresholds(daily_results(spark, sf))
    run = uuid.uuid4().hex[:12]
    sink = scratch_path(spark, "stream_live", run)
    q = start_live_scoring(spark, _arrivals(spark, sf), None, models.scaler, models.forest,
                           thr, sink, scratch_path(spark, "stream_live", run, "ckpt"), available_now=True)
    q.awaitTermination()
    return latest_scores(spark, sink)


@register("stream_live_latest", L.LIVE_COLS, ["close", "if_score", "threshold", "daily_ret", "vol_z"],
          O.with_(O.detect(O.bars_daily()), """
SELECT r.ticker, r."Date" AS date, r."Close" AS close, r.if_score, t.threshold, r.if_anomaly = 1 AS anomaly, r.daily_return AS daily_ret, r.volume_zscore AS vol_z
FROM results r JOIN thresholds t USING (ticker) QUALIFY row_number() OVER (PARTITION BY r.ticker ORDER BY r."Date" DESC) = 1"""))
def q_stream_live_latest(spark, sf):
    """The live view of the same stream: each ticker's newest scored bar."""
    return latest_per_ticker(q_stream_live(spark, sf))


@register("stream_state_scores", STREAM_COLS, STREAM_DOUBLES, STREAM_SQL)
def q_stream_state_scores(spark, sf):
    """Bars arrive file by file; keyed state carries each ticker's last bars."""
    from ..streaming.state_stream import start_state_scoring
    models = daily_models(spark, sf)
    thr = stored_thresholds(daily_results(spark, sf))
    run = uuid.uuid4().hex[:12]
    sink = scratch_path(spark, "stream_state", run)
    q = start_state_scoring(spark, _arrivals(spark, sf), models.scaler, models.forest, thr, sink,
                            scratch_path(spark, "stream_state", run, "ckpt"), available_now=True)
    q.awaitTermination()
    return latest_scores(spark, sink)
