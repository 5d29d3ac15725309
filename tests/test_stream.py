import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from tickscope.streaming.bars_stream import run_bars_available_now


def test_late_tick_dropped_and_in_time_kept(spark):
    src = tempfile.mkdtemp(prefix="tickscope-stream-src-")
    sink = tempfile.mkdtemp(prefix="tickscope-stream-out-")
    ck = tempfile.mkdtemp(prefix="tickscope-stream-ck-")
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)

    def write(name, rows):
        tbl = pa.table({
            "event_id": pa.array([r[0] for r in rows], pa.int64()),
            "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
            "user_id": pa.array([1] * len(rows), pa.int64()),
            "event_type": pa.array(["x"] * len(rows)),
            "value": pa.array([r[2] for r in rows], pa.float64()),
            "props": pa.array(["{}"] * len(rows)),
        })
        pq.write_table(tbl, os.path.join(src, name))

    # hour 0 and hour 5: watermark after the first file is 05:30 - 2h = 03:30
    write("events_1.parquet", [(1, t0 + dt.timedelta(minutes=10), 1.0), (2, t0 + dt.timedelta(minutes=20), 3.0),
                               (3, t0 + dt.timedelta(hours=5, minutes=30), 9.0)])
    out = run_bars_available_now(spark, src, sink, ck).collect()
    assert [(r.Open, r.Close, r.Volume) for r in out] == [(1.0, 3.0, 2.0)]
    # a tick for hour 0 arriving now is behind the watermark: dropped; hour 5 closes later
    write("events_2.parquet", [(4, t0 + dt.timedelta(minutes=30), 100.0), (5, t0 + dt.timedelta(hours=9), 2.0),
                               (3, t0 + dt.timedelta(hours=5, minutes=30), 9.0)])
    out = sorted(run_bars_available_now(spark, src, sink, ck).collect(), key=lambda r: r.Date)
    assert [(r.Date.hour, r.High, r.Volume) for r in out] == [(0, 3.0, 2.0), (5, 9.0, 1.0)]
    # restart from the checkpoint with no new input: nothing is added
    again = run_bars_available_now(spark, src, sink, ck).collect()
    assert len(again) == 2
