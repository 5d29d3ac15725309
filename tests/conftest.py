import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tickscope.session import configure
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickscope-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


def make_bars(spark, rows):
    """rows: list of (ticker, 'YYYY-MM-DD[ HH:MM:SS]', open, high, low, close, volume)."""
    import datetime as dt

    from tickscope.schemas import BARS_SCHEMA
    out = []
    for t, d, o, h, lo, c, v in rows:
        ts = dt.datetime.fromisoformat(d)
        out.append((t, ts, float(o), float(h), float(lo), float(c), float(v)))
    return spark.createDataFrame(out, BARS_SCHEMA)


def series(ticker, closes, volumes=None, start="2020-01-01", step_days=1):
    import datetime as dt
    base = dt.datetime.fromisoformat(start)
    vols = volumes or [1000.0 + (i * 37) % 101 for i in range(len(closes))]
    rows = []
    for i, (c, v) in enumerate(zip(closes, vols)):
        d = (base + dt.timedelta(days=i * step_days)).isoformat(sep=" ")
        rows.append((ticker, d, c, c * 1.01, c * 0.99, c, v))
    return rows
