import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_bars, series
from tickscope.operators.detect import DetectParams, Models, detect, detect_status, scored_features, train_or_reuse
from tickscope.operators.portfolio import data_view, export_csv
from tickscope.sources.bars import date_range, load_status, read_bars_csv, recent_bars, unique_bars, write_bars


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))))


def test_csv_round_trip_ticker_from_file_name(spark):
    bars = make_bars(spark, series("SPY", walk(5, 1)) + series("QQQ", walk(3, 2)))
    out = tempfile.mkdtemp(prefix="tickscope-csv-")
    for t in ("SPY", "QQQ"):
        pdf = bars.filter(F.col("ticker") == t).drop("ticker").toPandas()
        pdf["Date"] = pdf["Date"].dt.strftime("%Y-%m-%d")
        pdf.to_csv(os.path.join(out, f"{t}_raw.csv"), index=False)
    back = read_bars_csv(spark, out)
    got = {r.ticker: r[1] for r in back.groupBy("ticker").count().collect()}
    assert got == {"SPY": 5, "QQQ": 3}
    assert dict(back.dtypes)["Date"] == "timestamp_ntz"


def test_parquet_sink_partitioned_by_ticker(spark):
    bars = make_bars(spark, series("A", walk(4, 1)) + series("B", walk(4, 2)))
    out = os.path.join(tempfile.mkdtemp(prefix="tickscope-pq-"), "bars")
    write_bars(bars, out)
    assert sorted(p for p in os.listdir(out) if p.startswith("ticker=")) == ["ticker=A", "ticker=B"]
    write_bars(bars.filter(F.col("ticker") == "A").limit(2), out)   # replaces only A
    back = spark.read.parquet(out)
    got = {r.ticker: r[1] for r in back.groupBy("ticker").count().collect()}
    assert got == {"A": 2, "B": 4}


def test_range_status_recent(spark):
    bars = make_bars(spark, series("A", walk(30, 1)))
    assert date_range(bars, "2020-01-05", "2020-01-10").count() == 5
    st = {r.ticker: (r.n_rows, r.ok) for r in load_status(spark, bars, ["A", "Z"]).collect()}
    assert st == {"A": (30, True), "Z": (0, False)}
    assert recent_bars(bars, n_bars=7).count() == 7
    assert recent_bars(bars, days=3).count() == 4


def test_export_csv(spark):
    rows = [("A", "2020-01-01 00:00:00", 1.0, -0.5, 1, 1, 1)]
    import datetime as dt
    df = spark.createDataFrame(
        [(t, dt.datetime.fromisoformat(d), c, s, a, b, k, 0.1, -0.2) for t, d, c, s, a, b, k in rows],
        "ticker string, Date timestamp_ntz, Close double, if_score double, if_anomaly int, "
        "band_anomaly int, consensus_anomaly int, daily_return double, residual double")
    out = os.path.join(tempfile.mkdtemp(prefix="tickscope-exp-"), "view")
    export_csv(data_view(df, consensus_only=True), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns[:3] == ["Date", "ticker", "Close"] and back.count() == 1


def test_train_or_reuse_fits_only_missing(spark):
    bars_a = make_bars(spark, series("A", walk(120, 1)))
    bars_ab = make_bars(spark, series("A", walk(130, 1)) + series("B", walk(120, 2)))
    p = DetectParams(n_trees=10)
    stored = train_or_reuse(bars_a, None, False, p)
    stored = Models(stored.scaler.cache(), stored.forest.cache(), stored.baseline.cache())
    new = train_or_reuse(bars_ab, stored, False, p)
    assert all(sorted(r.ticker for r in t.select("ticker").distinct().collect()) == ["A", "B"] for t in (new.scaler, new.forest, new.baseline))
    # A was not refitted: same stored mean and band although A has new bars
    for old, now, c in ((stored.scaler, new.scaler, "mean_daily_return"), (stored.baseline, new.baseline, "sigma")):
        assert old.first()[c] == now.filter(F.col("ticker") == "A").first()[c]
    assert new.forest.filter(F.col("ticker") == "B").count() == 10
    assert train_or_reuse(bars_ab, stored, True, p).scaler.filter(F.col("ticker") == "A").first()["n_rows"] == 81
    assert train_or_reuse(bars_a, stored, False, p) is stored


def test_stored_baseline_is_reused_and_its_band_widens_after_training(spark):
    bars = make_bars(spark, series("A", walk(400, 1)))
    p = DetectParams(n_trees=10)
    models = scored_features(date_range(bars, end="2020-12-01"), p)[1]
    models = Models(models.scaler.cache(), models.forest.cache(), models.baseline.cache())
    out = detect(bars, p, models).toPandas().sort_values("Date")
    width = (out.yhat_upper - out.yhat_lower).to_numpy()
    inside = (out.Date < "2020-12-01").to_numpy()
    assert np.allclose(width[inside], width[0]) and (np.diff(width[~inside]) >= 0).all()
    assert models.baseline.first()["n"] < 400


def test_csv_columns_by_name(spark):
    out = tempfile.mkdtemp(prefix="tickscope-csv-")
    with open(os.path.join(out, "AA_raw.csv"), "w") as f:
        f.write("Date,Close,High,Low,Open,Volume\n2020-01-01,11,12,9,10,100\n2020-01-02 00:00:00-05:00,21,22,19,20,\n")
    with open(os.path.join(out, "BB_raw.csv"), "w") as f:
        f.write('"Date","Open","High","Low","Close","Volume","Adj Close"\r\n2020-01-01,10,12,9,11,100,1\r\n')
    got = {(r.ticker, str(r.Date)[:10]): (r.Open, r.High, r.Low, r.Close, r.Volume) for r in read_bars_csv(spark, out).collect()}
    assert got == {("AA", "2020-01-01"): (10, 12, 9, 11, 100), ("AA", "2020-01-02"): (20, 22, 19, 21, None), ("BB", "2020-01-01"): (10, 12, 9, 11, 100)}
    for bad in ("Date,Close,High,Low,Volume\n2020-01-01,11,12,9,100\n", "Date,Close,High,Low,Open,Volume\n2020-01-01,x,12,9,10,100\n"):
        with open(os.path.join(out, "CC_raw.csv"), "w") as f:
            f.write(bad)
        with pytest.raises(Exception, match="no header with|is no number"):
            read_bars_csv(spark, out).collect()


HEAD = "Date,Open,High,Low,Close,Volume\n"


def _folder(**files):
    out = tempfile.mkdtemp(prefix="tickscope-csv-")
    for name, text in files.items():
        with open(os.path.join(out, f"{name}_raw.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return out


def test_csv_quoting_follows_the_parser(spark):
    out = _folder(Q='\ufeff"Date","note, with comma",Volume,"Close",Low,High,Open\r\n2024-01-02,"a, ""b"", c","1234.5",4, 3 ,5,"1"\r\n\r\n2024-01-03,Date,NaN,null,,1e3,+.5\n',
                  R=HEAD + "2024-01-02,1,2,3,4,5\n", S="Volume,Close,Date,Open,High,Low\ninf,9,2024-01-02,1,2,3\n", T="Volume,t,Close,Date,Open,High,Low\n1,Date,9,2024-01-02,1,2,3\n")
    got = {(r.ticker, str(r.Date)[:10]): (r.Open, r.High, r.Low, r.Close, r.Volume) for r in read_bars_csv(spark, out).collect()}
    assert got == {("Q", "2024-01-02"): (1, 5, 3, 4, 1234.5), ("Q", "2024-01-03"): (0.5, 1000, None, None, None),
                   ("R", "2024-01-02"): (1, 2, 3, 4, 5), ("S", "2024-01-02"): (1, 2, 3, 9, float("inf")), ("T", "2024-01-02"): (1, 2, 3, 9, 1)}


BAD_LINES = ['2024-01-02,10,11,9,10.5,"1,234"', '2024-01-03,"1,010",1020,1000,1015,500', "2024-01-03,1,2", "2024-01-03,1,2,3,4,5,6", "2024-01-03,1,2,3,4,5d", '2024-01-03,1,2,3,"4,5', "soon,1,2,3,4,5"]


@pytest.mark.parametrize("line", BAD_LINES)
def test_csv_lines_that_are_refused(spark, line):
    with pytest.raises(Exception, match="is no number|MALFORMED|CAST_INVALID_INPUT"):
        read_bars_csv(spark, _folder(A=HEAD + "2024-01-01,1,2,3,4,5\n" + line + "\n")).collect()


def test_csv_without_header_or_column(spark):
    with pytest.raises(Exception, match="no header with"):
        read_bars_csv(spark, _folder(A=HEAD, B="2024-01-01,1,2,3,4,5\n")).collect()
    assert read_bars_csv(spark, _folder(A=HEAD)).count() == 0


def test_csv_stream_uses_the_same_parser(spark):
    from tickscope.streaming.live_stream import new_bars, read_bar_stream
    good = 'Volume,Close,Low,High,Open,Date,"x,y"\n"7",4,3,5,1,2024-01-02,"q, r"\n'
    for text, bad in ((good, False), *[(HEAD + line + "\n", True) for line in BAD_LINES[:3]]):
        seen = []
        q = (read_bar_stream(spark, _folder(A=text), fmt="csv").writeStream.foreachBatch(lambda b, _: seen.extend(new_bars(b).collect()))
             .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
        if bad:
            with pytest.raises(Exception, match="is no number|MALFORMED|STREAM_FAILED|FOREACH_BATCH"):
                q.awaitTermination()
        else:
            q.awaitTermination()
            assert [tuple(r)[2:] for r in seen] == [(1, 5, 3, 4, 7)]


def test_unique_bars_do_not_depend_on_row_order(spark):
    rows = series("A", walk(5, 1)) + [("A", "2020-01-03", 1.0, 2.0, 0.5, 1.5, 7.0)]
    a, b = (sorted(unique_bars(make_bars(spark, r)).collect()) for r in (rows, rows[::-1]))
    assert a == b and len(a) == 5


def test_table_key_follows_the_files(spark):
    from tickscope.plans.tables import table_key
    out = tempfile.mkdtemp(prefix="tickscope-key-")
    spark.range(3).write.parquet(os.path.join(out, "t.parquet"))
    one = table_key(spark, out, ["t"], 1)
    spark.range(4).write.mode("append").parquet(os.path.join(out, "t.parquet"))
    assert table_key(spark, out, ["t"], 1) != one


def test_detect_status_isolates_failures(spark):
    vols = [1000.0 + (i * 37) % 101 for i in range(100)]
    vols[60] = 0.0                      # zero volume past the warm-up: the next bar's change is infinite
    closes = walk(100, 3)
    closes[60] = 0.0                    # zero close without a range: its own row is undefined, the next twenty have no volatility
    bars = make_bars(spark, series("BAD", walk(100, 3), vols) + series("GAP", closes) + series("OK", walk(100, 4)) + series("SHORT", walk(30, 5)))
    st = {r.ticker: (r.ok, r.reason) for r in detect_status(bars, ["BAD", "GAP", "OK", "SHORT", "NONE"]).collect()}
    assert st == {"BAD": (False, "non-finite feature"), "GAP": (True, None), "OK": (True, None),
                  "SHORT": (False, "too few feature rows"), "NONE": (False, "no data")}
