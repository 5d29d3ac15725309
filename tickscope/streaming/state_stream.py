"""Keyed-state continuous scoring (X6): every new bar scored, no history re-read but for bars too old for the state.

``transformWithStateInPandas`` keeps, per ticker, the last RING bars as a map from bar time to values (RocksDB state store): twice the longest feature
look-back (49), so that bars after a late or corrected one within the last 49 can be scored again exactly. A
micro-batch's bars pass through in the pieces Spark hands over (``is_new`` true), never as one group; a batch writes the bars that are new,
removes those that leave the ring, and reads the values of those alone that its new bars need: the look-back before the first of them and what follows it. These
are given out after them (``is_new`` false, without the bars replaced). A ``foreachBatch``
then orders the rows with ordinary windows (split when a series is long), scores each new bar and each bar whose
look-back holds a new one with the stored scaler and forest, flags them against the stored thresholds, and
adds the scores to the sink; a replayed batch adds nothing.

The sink is a ``RunStore`` of the accepted bars and the scores. A bar with fewer than 49 bars of a full ring
before it (``is_late``) lacks its look-back there, older bars being dropped: the batch's bars of its ticker are scored by
``score_batch`` over the stored bars around them instead, as are the bars after them, and stay out of the ring's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import comparable
from ..operators.features import build_features
from ..operators.live import score_rows, with_thresholds
from ..operators.windows import over_series, series_stats
from ..schemas import BARS_SCHEMA, KEY, OHLCV, TIME, WARMUP_BARS
from ..sources.bars import unique_bars
from .live_stream import SCORE_COLS, SCORE_SCHEMA, around, score_batch
from .store import RunStore

RING = 2 * WARMUP_BARS
HALO_SCHEMA = ("ticker string, Date timestamp_ntz, Open double, High double, Low double, "
               "Close double, Volume double, is_new boolean, is_late boolean")
VALUE_SCHEMA = "open double, high double, low double, close double, volume double"
PROVIDER_CONF, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RingProcessor(StatefulProcessor):
    """The last ``size`` bars of a ticker, by time."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "micros long", VALUE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = sorted(k[0] for k in self.bars.keys())
        # up to here a full ring doesn't hold the look-back
        edge = before[min(WARMUP_BARS, self.size) - 1] if len(before) >= self.size else None
        stored, replaced, first = set(before), set(), None
        fresh: dict[int, tuple] = {}
        for new in rows:
            micros = pd.to_datetime(new[TIME]).astype("datetime64[us]").astype("int64")
            late = micros <= edge if edge is not None else False
            yield new.assign(is_new=True, is_late=late)[[KEY, TIME, *OHLCV, "is_new", "is_late"]]
            first = min([*micros, *([] if first is None else [first])])
            replaced |= stored.intersection(micros)
            # of equal times the greatest values stay, as in the batch's own choice; of a long batch only what can be in the ring
            for m, values in zip(micros.tolist(), new[OHLCV].itertuples(index=False, name=None)):
                if m not in fresh or fresh[m] < values:
                    fresh[m] = values
            if len(fresh) > 2 * self.size:
                fresh = {m: fresh[m] for m in sorted(fresh)[-self.size:]}
        ring = sorted({*before, *fresh})[-self.size:]
        kept = set(ring)
        lead = [m for m in before if m < first][-WARMUP_BARS:]
        needed = [*lead, *[m for m in before if m > first and m not in replaced]]
        old = [(m, *self.bars.getValue((m,))) for m in needed]
        for m in before:
            if m not in kept:
                self.bars.removeKey((m,))
        for m, values in fresh.items():
            if m in kept:
                self.bars.updateValue((m,), values)
        if old:
            out = pd.DataFrame(old, columns=["_m", *OHLCV])
            yield out.assign(ticker=key[0], Date=pd.to_datetime(out["_m"], unit="us"), is_new=False, is_late=False)[[KEY, TIME, *OHLCV, "is_new", "is_late"]]

    def close(self) -> None:
        pass


def with_halo(bar_stream: DataFrame, halo: int = RING) -> DataFrame:
    """Streaming rows: each ticker's new bars plus those of its last ``halo`` stored bars that they need."""
    return (bar_stream.select(KEY, TIME, *OHLCV).groupBy(KEY)
            .transformWithStateInPandas(RingProcessor(halo), HALO_SCHEMA, "append", "none"))


def score_new_bars(batch: DataFrame, scaler: DataFrame, forest: DataFrame,
                   thresholds: DataFrame | None) -> DataFrame:
    fresh = unique_bars(batch.filter("is_new")).withColumn("_new", F.lit(1))
    bars = batch.filter(~F.col("is_new")).select(KEY, TIME, *OHLCV).withColumn("_new", F.lit(0)).unionByName(fresh)
    stats = series_stats(bars)

    def touched(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("_touched", F.max("_new").over(Window.partitionBy(*keys).orderBy(TIME).rowsBetween(-WARMUP_BARS, 0)))
    feat = build_features(over_series(bars, touched, WARMUP_BARS, stats=stats), stats).filter(F.col("_touched") == 1)
    scored = with_thresholds(score_rows(feat, scaler, forest, ["Close", "daily_return", "volume_zscore"]), thresholds)
    flag = F.coalesce(comparable(F.col("if_score")) <= F.col("threshold"), F.lit(False)).cast("int")
    return scored.withColumn("if_anomaly", flag).select(*SCORE_COLS)


def start_state_scoring(spark: SparkSession, bar_stream: DataFrame, scaler: DataFrame,
                        forest: DataFrame, thresholds: DataFrame | None, sink_dir: str,
                        checkpoint: str, available_now: bool = False,
                        processing_time: str = "300 seconds"):
    store = RunStore(spark, sink_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.checkpoint(eager=True)   # the stateful step runs once
        if batch_id <= store.state()["batch"]:
            return
        run = store.write("bars", unique_bars(batch.filter("is_new")), batch_id)
        late = batch.filter("is_late").select(KEY).distinct()
        if late.isEmpty():
            scored = score_new_bars(batch, scaler, forest, thresholds)
        else:
            bars = store.read_runs([run], BARS_SCHEMA).drop("batch_id").join(late, KEY, "left_semi")
            exact = score_batch(bars, around(store, bars).drop("batch_id").withColumn("version", F.lit(0)), scaler, forest, thresholds)
            scored = score_new_bars(batch.join(late, KEY, "left_anti"), scaler, forest, thresholds).unionByName(exact)
        store.publish(batch_id, {"bars": run, "scores": store.write("scores", scored, batch_id)})
        store.compact("bars", BARS_SCHEMA, [KEY, TIME])
        store.compact("scores", SCORE_SCHEMA, [KEY, TIME])

    writer = (with_halo(bar_stream).writeStream.outputMode("append").foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    # map state needs RocksDB; a query takes the setting with it when it starts
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER_CONF) if before is None else spark.conf.set(PROVIDER_CONF, before)
