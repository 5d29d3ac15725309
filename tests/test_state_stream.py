import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import make_bars, series
from tickscope.operators.detect import DetectParams, fit_and_detect
from tickscope.operators.portfolio import stored_thresholds
from tickscope.schemas import BARS_SCHEMA
from tickscope.streaming.live_stream import SCORE_SCHEMA, read_bar_stream
from tickscope.streaming.store import RunStore
from tickscope.streaming.state_stream import start_state_scoring


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))))


def test_state_scoring_equals_batch(spark):
    rows = series("A", walk(160, 1)) + series("B", walk(140, 2))
    bars = make_bars(spark, rows)
    scaler, forest, results = fit_and_detect(bars, DetectParams(n_trees=20, baseline="decompose"))
    scaler, forest, results = scaler.cache(), forest.cache(), results.cache()
    thr = stored_thresholds(results).cache()
    src = tempfile.mkdtemp(prefix="tickscope-state-src-")
    pdf = bars.toPandas().sort_values("Date")
    # three arrival files: the later ones need the halo carried in the state store
    cuts = [0, len(pdf) // 3, 2 * len(pdf) // 3, len(pdf)]
    for i, part in enumerate(pdf.iloc[cuts[j]:cuts[j + 1]] for j in range(3)):
        spark.createDataFrame(part, BARS_SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
    flat = tempfile.mkdtemp(prefix="tickscope-state-flat-")
    for i in range(3):
        d = os.path.join(src, f"f{i}")
        for name in os.listdir(d):
            if name.endswith(".parquet"):
                os.link(os.path.join(d, name), os.path.join(flat, f"{i:02d}-{name}"))
    sink = tempfile.mkdtemp(prefix="tickscope-state-out-")
    ck = tempfile.mkdtemp(prefix="tickscope-state-ck-")
    q = start_state_scoring(spark, read_bar_stream(spark, flat, max_files=1), scaler, forest, thr,
                            sink, ck, available_now=True)
    q.awaitTermination()
    got = RunStore(spark, sink).read("scores", SCORE_SCHEMA)
    assert got.select("batch_id").distinct().count() == 3
    assert got.count() == results.count()      # files in order of time: no bar is scored twice
    a = got.select("ticker", "Date", "if_score", "if_anomaly").toPandas().sort_values(["ticker", "Date"])
    b = results.select("ticker", "Date", "if_score", "if_anomaly").toPandas().sort_values(["ticker", "Date"])
    assert len(a) == len(b)
    np.testing.assert_allclose(a.if_score.to_numpy(), b.if_score.to_numpy(), rtol=0, atol=1e-12)
    assert (a.if_anomaly.to_numpy() == b.if_anomaly.to_numpy()).all()
    _ = pd, F


def _files(spark, parts):
    """One parquet file a part, arriving in order."""
    flat = tempfile.mkdtemp(prefix="tickscope-live-src-")
    for i, rows in enumerate(parts):
        out = os.path.join(tempfile.mkdtemp(prefix="tickscope-live-part-"), "p")
        make_bars(spark, rows).coalesce(1).write.parquet(out)
        for name in os.listdir(out):
            if name.endswith(".parquet"):
                os.link(os.path.join(out, name), os.path.join(flat, f"{i:02d}-{name}"))
    return flat


def _trained(spark, rows):
    scaler, forest, results = fit_and_detect(make_bars(spark, rows), DetectParams(n_trees=20, baseline="decompose"))
    return scaler.cache(), forest.cache(), results.cache()


def _held(spark, checkpoint):
    """The bar times in the state, by ticker."""
    rows = spark.read.format("statestore").option("stateVarName", "bars").load(checkpoint).selectExpr("key.ticker ticker", "user_map_key.micros micros").collect()
    out = {}
    for r in rows:
        out.setdefault(r["ticker"], []).append(r["micros"])
    return out


def _micros(day):
    import datetime as dt
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp()) * 10 ** 6


def _same(got, results):
    a = got.select("ticker", "Date", "if_score").toPandas().sort_values(["ticker", "Date"])
    b = results.select("ticker", "Date", "if_score").toPandas().sort_values(["ticker", "Date"])
    assert len(a) == len(b)
    np.testing.assert_allclose(a.if_score.to_numpy(), b.if_score.to_numpy(), rtol=0, atol=1e-12)


def test_live_scoring_over_batches_equals_batch(spark):
    """From a short history, then file by file, with a late bar and a corrected one: every newest score is the batch run's."""
    from tickscope.streaming.live_stream import latest_scores, start_live_scoring
    rows = series("A", walk(170, 1)) + series("B", walk(150, 2))
    wrong = list(rows[130])
    wrong[5] *= 1.3                                             # bar 130 of A comes wrong first
    a, b = rows[:170], rows[170:]
    parts = [a[60:100] + b[20:90], a[100:118] + a[119:130] + [tuple(wrong)] + a[131:140] + b[90:110], [a[118], a[130]], a[140:] + b[110:]]
    scaler, forest, results = _trained(spark, rows)
    sink, ck = tempfile.mkdtemp(prefix="tickscope-live-out-"), tempfile.mkdtemp(prefix="tickscope-live-ck-")
    q = start_live_scoring(spark, read_bar_stream(spark, _files(spark, parts), max_files=1), make_bars(spark, a[:60] + b[:20]), scaler, forest, None, sink, ck, available_now=True)
    q.awaitTermination()
    got = latest_scores(spark, sink)
    first = {"A": a[60][1], "B": b[20][1]}
    _same(got, results.filter((F.col("ticker") == "B") | (F.col("Date") >= F.lit(first["A"]).cast("timestamp_ntz"))))
    assert spark.read.parquet(f"{sink}/summary").count() == 4


def test_state_scoring_with_a_late_bar_inside_the_ring(spark):
    from tickscope.streaming.live_stream import latest_scores
    rows = series("A", walk(200, 3))
    parts = [rows[:150] + rows[151:170], [rows[150]], rows[170:]]
    scaler, forest, results = _trained(spark, rows)
    sink, ck = tempfile.mkdtemp(prefix="tickscope-state-out-"), tempfile.mkdtemp(prefix="tickscope-state-ck-")
    q = start_state_scoring(spark, read_bar_stream(spark, _files(spark, parts), max_files=1), scaler, forest, None, sink, ck, available_now=True)
    q.awaitTermination()
    _same(latest_scores(spark, sink), results)


def test_state_scoring_with_bars_older_than_the_ring(spark):
    """Late and corrected bars 150 and 70 bars old beside new ones: every newest score is the batch run's."""
    from tickscope.streaming.live_stream import latest_scores
    rows = series("A", walk(300, 5)) + series("B", walk(260, 6))
    a, b = rows[:300], rows[300:]
    wrong = list(a[175])
    wrong[5] *= 1.3                                             # bar 175 of A comes wrong first
    first = [r for i, r in enumerate(a[:250]) if i not in (99, 100, 101, 175)] + [tuple(wrong)] + b[:200]
    # the first batch is longer than the state; the state holds the last bars of each ticker and nothing else
    parts = [first, [a[100]] + b[200:230], [a[99], a[101], *a[250:260]] + b[230:250], [a[175], *a[260:270]], a[270:] + b[250:]]
    scaler, forest, results = _trained(spark, rows)
    sink, ck = tempfile.mkdtemp(prefix="tickscope-state-out-"), tempfile.mkdtemp(prefix="tickscope-state-ck-")
    q = start_state_scoring(spark, read_bar_stream(spark, _files(spark, parts), max_files=1), scaler, forest, None, sink, ck, available_now=True)
    q.awaitTermination()
    _same(latest_scores(spark, sink), results)
    held = _held(spark, ck)
    assert {t: (len(m), max(m)) for t, m in held.items()} == {"A": (98, _micros(a[299][1])), "B": (98, _micros(b[259][1]))}


def test_a_restart_takes_up_new_models(spark):
    from tickscope.streaming.live_stream import start_live_scoring
    rows = series("A", walk(130, 8))
    first = _trained(spark, rows[:100])
    second = _trained(spark, rows)
    src = _files(spark, [rows[:100]])
    sink, ck = tempfile.mkdtemp(prefix="tickscope-live-out-"), tempfile.mkdtemp(prefix="tickscope-live-ck-")
    for models, more in ((first, None), (second, rows[100:])):
        if more:
            out = os.path.join(tempfile.mkdtemp(prefix="tickscope-live-part-"), "p")
            make_bars(spark, more).coalesce(1).write.parquet(out)
            for name in os.listdir(out):
                if name.endswith(".parquet"):
                    os.link(os.path.join(out, name), os.path.join(src, f"99-{name}"))
        start_live_scoring(spark, read_bar_stream(spark, src, max_files=1), None, models[0], models[1], None, sink, ck, available_now=True).awaitTermination()
    got = RunStore(spark, sink).read("scores", SCORE_SCHEMA)
    cut = F.lit(rows[100][1]).cast("timestamp_ntz")
    for batch, models, part in ((0, first, F.col("Date") < cut), (1, second, F.col("Date") >= cut)):
        _same(got.filter(f"batch_id = {batch}"), models[2].filter(part))
