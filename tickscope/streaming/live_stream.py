"""Continuous scoring of new bars with stored models (Structured Streaming).

A query keeps three tables beside its output, all under one pointer (``RunStore``): every accepted bar, the last TAIL bars of each
ticker, and every score. A micro-batch reads the tails of the tickers it touches, no matter how old the stream is: features of a tail with the new bars are exact
for every bar that has LOOK_BACK bars of the tail before it, and so for the bars after a corrected or late one, whose features it changes: all of them are scored.
A bar too old for that reads the stored bars around it, a date range that is widened until it holds the look-back on both sides.
Scores are added by (ticker, Date), the newest batch's counts; ``latest_scores`` merges the runs. A batch takes effect by one rename
at its end; replaying it adds nothing. A history given at the start is stored as batch -1 when the sink is new.
Models and thresholds are read once when the query starts (stream-static joins); a restart takes those it is given.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detect import comparable
from ..operators.features import build_features
from ..operators.live import anomalous_tickers, live_summary, score_rows, with_thresholds
from ..operators.windows import over_series, series_stats
from ..schemas import BARS_SCHEMA, KEY, OHLCV, TIME, WARMUP_BARS
from ..sources.bars import bar_lines, parse_bar_lines, unique_bars
from .store import RunStore, newest

#: Bars before the first new one that a batch needs: the longest look-back of a feature.
LOOK_BACK = WARMUP_BARS
#: Bars kept of a ticker: a look-back before and after, so that a late bar among the newest LOOK_BACK is scored from the tail.
TAIL = 2 * WARMUP_BARS
BAR = "Date timestamp_ntz, Open double, High double, Low double, Close double, Volume double"
TAIL_SCHEMA = f"ticker string, bars array<struct<{', '.join(p.replace(' ', ': ') for p in BAR.split(', '))}>>, cut boolean"
SCORE_SCHEMA = "ticker string, Date timestamp_ntz, Close double, if_score double, threshold double, if_anomaly int, daily_return double, volume_zscore double"
SCORE_COLS = [KEY, TIME, "Close", "if_score", "threshold", "if_anomaly", "daily_return", "volume_zscore"]


def read_bar_stream(spark: SparkSession, directory: str, max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Bars of parquet files (``fmt`` parquet), or lines of ``{ticker}_raw.csv`` files that each batch parses (``csv``)."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        return bar_lines(reader, directory)
    return reader.schema(BARS_SCHEMA).parquet(directory).withColumn("version", F.col("_metadata.file_modification_time"))


def new_bars(batch: DataFrame) -> DataFrame:
    """A micro-batch as bars, one a (ticker, Date): of several the one from the newest file."""
    bars = parse_bar_lines(batch) if "value" in batch.columns else batch
    return unique_bars(bars, "version" if "version" in bars.columns else None)


def tails_after(tails: DataFrame, bars: DataFrame) -> DataFrame:
    """The tails of the tickers in ``bars`` with these bars: (ticker, bars, cut), ``cut`` if older bars were left out."""
    last = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    ranked = bars.select(KEY, TIME, *OHLCV).withColumn("_rn", F.row_number().over(last))
    fresh = ranked.filter(F.col("_rn") <= TAIL + 1).withColumn("batch_id", F.lit(1))
    old = tails.select(KEY, "cut", F.explode("bars").alias("b")).select(KEY, "b.*", "cut")
    both = fresh.drop("_rn").unionByName(old.select(KEY, TIME, *OHLCV).withColumn("batch_id", F.lit(0)))
    placed = newest(both, [KEY, TIME]).withColumn("_rn", F.row_number().over(last))
    kept = F.collect_list(F.when(F.col("_rn") <= TAIL, F.struct(TIME, *OHLCV)))
    out = placed.filter(F.col("_rn") <= TAIL + 1).groupBy(KEY).agg(F.array_sort(kept).alias("bars"), (F.max("_rn") > TAIL).alias("more"))
    return out.join(tails.select(KEY, "cut"), KEY, "left").select(KEY, "bars", (F.col("more") | F.coalesce("cut", F.lit(False))).alias("cut"))


def too_old(bars: DataFrame, tails: DataFrame) -> DataFrame:
    """The bars whose look-back the tails don't hold."""
    edge = tails.filter("cut").select(KEY, F.col("bars")[LOOK_BACK - 1][TIME].alias("_edge"))
    return bars.join(edge, KEY).filter(F.col(TIME) <= F.col("_edge")).drop("_edge")


def around(store: RunStore, late: DataFrame, days: int = 128) -> DataFrame:
    """The stored bars of the late bars' tickers (newest version) in a range of time that holds LOOK_BACK bars on both sides of them."""
    spans = late.groupBy(KEY).agg(F.min(TIME).alias("_from"), F.max(TIME).alias("_to")).checkpoint()
    lo, hi = spans.agg(F.min("_from"), F.max("_to")).first()
    extent = store.extent("bars")
    while True:
        first, last = lo - dt.timedelta(days=days), hi + dt.timedelta(days=days)
        rows = newest(store.read("bars", BARS_SCHEMA, first, last).join(spans.select(KEY), KEY, "left_semi"), [KEY, TIME])
        sides = rows.join(spans, KEY).groupBy(KEY).agg(F.count_if(F.col(TIME) < F.col("_from")).alias("b"), F.count_if(F.col(TIME) > F.col("_to")).alias("a"))
        need = spans.join(sides, KEY, "left").agg(F.min(F.coalesce("b", F.lit(0))), F.min(F.coalesce("a", F.lit(0)))).first()
        if extent is None or ((need[0] >= LOOK_BACK or first <= extent[0]) and (need[1] >= LOOK_BACK or last >= extent[1])):
            return rows
        days *= 4


def score_batch(batch: DataFrame, known: DataFrame, scaler: DataFrame, forest: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    """Scores of the batch's bars and of those whose look-back holds one; ``known``: bars before, with ``version``."""
    first = batch.groupBy(KEY).agg(F.min(TIME).alias("_first"))
    before = unique_bars(known.join(first.select(KEY), KEY, "left_semi"), "version").join(first, KEY)
    newest = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    lead = (before.filter(F.col(TIME) < F.col("_first")).withColumn("_rn", F.row_number().over(newest))
            .filter(F.col("_rn") <= LOOK_BACK).select(KEY, TIME, *OHLCV))
    later = (before.filter(F.col(TIME) >= F.col("_first")).join(batch.select(KEY, TIME), [KEY, TIME], "left_anti")
             .select(KEY, TIME, *OHLCV))
    old = lead.unionByName(later).withColumn("_new", F.lit(0))
    part = old.unionByName(batch.select(KEY, TIME, *OHLCV).withColumn("_new", F.lit(1))).checkpoint(eager=True)
    stats = series_stats(part)

    def touched(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("_touched", F.max("_new").over(Window.partitionBy(*keys).orderBy(TIME).rowsBetween(-LOOK_BACK, 0)))
    feat = build_features(over_series(part, touched, LOOK_BACK, stats=stats), stats).filter(F.col("_touched") == 1)
    scored = with_thresholds(score_rows(feat, scaler, forest, ["Close", "daily_return", "volume_zscore"]), thresholds)
    flag = F.coalesce(comparable(F.col("if_score")) <= F.col("threshold"), F.lit(False)).cast("int")
    return scored.withColumn("if_anomaly", flag).select(*SCORE_COLS)


def latest_scores(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest score of every (ticker, Date) that a query has written."""
    return newest(RunStore(spark, sink_dir).read("scores", SCORE_SCHEMA), [KEY, TIME]).select(*SCORE_COLS)


def latest_per_ticker(scores: DataFrame) -> DataFrame:
    """The live view: each ticker's newest scored bar, with the live scorer's column names."""
    value = F.struct(TIME, "Close", "if_score", "threshold", "if_anomaly", "daily_return", "volume_zscore")
    last = scores.groupBy(KEY).agg(F.max_by(value, F.col(TIME)).alias("r"))
    return last.select(KEY, F.col(f"r.{TIME}").alias("date"), F.col("r.Close").alias("close"), "r.if_score", "r.threshold",
                       (F.col("r.if_anomaly") == 1).alias("anomaly"), F.col("r.daily_return").alias("daily_ret"),
                       F.col("r.volume_zscore").alias("vol_z"))


def seed(store: RunStore, history: DataFrame | None) -> None:
    """Stores the history of a new sink as batch -1."""
    if history is None or store.state()["version"] >= 0:
        return
    run = store.write("bars", unique_bars(history.select(KEY, TIME, *OHLCV)).repartitionByRange(TIME, KEY), -1)
    if run:
        tails = tails_after(store.spark.createDataFrame([], TAIL_SCHEMA), store.read_runs([run], BARS_SCHEMA).drop("batch_id"))
        store.publish(-1, {"bars": run, "tail": store.write("tail", tails, -1)})


def apply_batch(store: RunStore, bars: DataFrame, batch_id: int, scaler: DataFrame, forest: DataFrame, thresholds: DataFrame | None) -> DataFrame | None:
    """Scores a batch (one bar a (ticker, Date)) and makes it part of the store; its scores, or None for a replayed or empty batch."""
    if batch_id <= store.state()["batch"]:
        return None
    run = store.write("bars", bars.select(KEY, TIME, *OHLCV), batch_id)
    if run is None:
        store.publish(batch_id, {})
        return None
    new = store.read_runs([run], BARS_SCHEMA).drop("batch_id")
    touched = new.select(KEY).distinct()
    tails = newest(store.read("tail", TAIL_SCHEMA), [KEY]).join(touched, KEY, "left_semi").drop("batch_id").checkpoint()
    late = too_old(new, tails).checkpoint()
    known = tails.select(KEY, F.explode("bars").alias("b")).select(KEY, "b.*").withColumn("version", F.lit(0))
    if late.isEmpty():
        scored = score_batch(new, known, scaler, forest, thresholds)
    else:
        timely = new.join(late.select(KEY, TIME), [KEY, TIME], "left_anti")
        beside = lambda df, other: df.unionByName(other.withColumn("version", F.lit(1)))
        old = around(store, late).drop("batch_id").withColumn("version", F.lit(0))
        scored = score_batch(late, beside(old, timely), scaler, forest, thresholds).unionByName(score_batch(timely, beside(known, late), scaler, forest, thresholds))
        scored = scored.dropDuplicates([KEY, TIME])
    scores = store.write("scores", scored, batch_id)
    store.publish(batch_id, {"bars": run, "scores": scores, "tail": store.write("tail", tails_after(tails, new), batch_id)})
    store.compact("tail", TAIL_SCHEMA, [KEY], whole=True)
    store.compact("bars", BARS_SCHEMA, [KEY, TIME])
    store.compact("scores", SCORE_SCHEMA, [KEY, TIME])
    return store.read_runs([scores] if scores else [], SCORE_SCHEMA)


def start_live_scoring(spark: SparkSession, bar_stream: DataFrame, history: DataFrame | None,
                       scaler: DataFrame, forest: DataFrame, thresholds: DataFrame | None,
                       sink_dir: str, checkpoint: str, available_now: bool = False,
                       processing_time: str = "300 seconds"):
    store = RunStore(spark, sink_dir)
    seed(store, history)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        scores = apply_batch(store, new_bars(batch), batch_id, scaler, forest, thresholds)
        if scores is not None:
            latest = latest_per_ticker(scores)
            live_summary(latest).write.mode("overwrite").parquet(f"{sink_dir}/summary/batch_id={batch_id}")
            anomalous_tickers(latest).write.mode("overwrite").parquet(f"{sink_dir}/anomalous/batch_id={batch_id}")

    writer = bar_stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
