import os
import tempfile

import numpy as np

from conftest import make_bars, series
from tickscope.sources.pointer import TableSet


def test_cli_detect_then_alerts(spark, capsys):
    from tickscope.__main__ import main
    rng = np.random.default_rng(4)
    rows = series("A", list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))))
    root = tempfile.mkdtemp(prefix="tickscope-cli-")
    make_bars(spark, rows).write.parquet(os.path.join(root, "bars"))
    out = os.path.join(root, "out")
    main(["detect", "--bars", os.path.join(root, "bars"), "--parquet", "--out", out])
    assert sorted(os.listdir(out)) == ["_versions", "baseline", "forest", "results", "scaler"]
    main(["detect", "--bars", os.path.join(root, "bars"), "--parquet", "--out", out])   # reuse path
    main(["alerts", "--out", out, "--lookback", "400", "--as-of", "2020-04-30"])
    text = capsys.readouterr().out
    assert "consensus" in text and "IF" in text


def test_cli_live_reads_a_folder_of_csv_files_and_stale_results_go_live(spark, capsys):
    from tickscope.__main__ import main
    rng = np.random.default_rng(5)
    root = tempfile.mkdtemp(prefix="tickscope-cli-")
    bars, out = os.path.join(root, "raw"), os.path.join(root, "out")
    os.makedirs(bars)
    for t in ("AA", "BB"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 110)))
        days = np.arange("2020-01-01", "2020-04-20", dtype="datetime64[D]")
        with open(os.path.join(bars, f"{t}_raw.csv"), "w") as f:
            f.write("Date,Close,High,Low,Open,Volume\n" + "".join(f"{d},{c},{c * 1.01},{c * 0.99},{c},{1000 + i * 37 % 101}\n" for i, (d, c) in enumerate(zip(days, close))))
    main(["detect", "--bars", bars, "--out", out, "--baseline", "decompose"])
    main(["live", "--bars", bars, "--out", out, "--available-now"])
    from tickscope.streaming.live_stream import latest_scores
    results, live = (df.toPandas().sort_values(["ticker", "Date"]) for df in (TableSet(spark, out).read("results")[0], latest_scores(spark, os.path.join(out, "live"))))
    assert len(live) == len(results) == 2 * 61
    np.testing.assert_allclose(live.if_score.to_numpy(), results.if_score.to_numpy(), rtol=0, atol=1e-12)
    capsys.readouterr()
    main(["alerts", "--out", out, "--bars", bars, "--as-of", "2021-01-01"])     # long after the last bar: live
    assert "consensus" not in capsys.readouterr().out


def test_a_killed_run_leaves_the_old_set(spark, monkeypatch, capsys):
    """Between any two of the tables that a retraining writes, readers see the old models and results."""
    import pytest

    from tickscope import __main__ as cli
    rng = np.random.default_rng(6)
    rows = series("A", list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 110)))))
    root = tempfile.mkdtemp(prefix="tickscope-cli-")
    out, bars = os.path.join(root, "out"), os.path.join(root, "bars")
    assert cli._models(spark, out) is None
    make_bars(spark, rows[:100]).write.parquet(bars)
    args = ["detect", "--bars", bars, "--parquet", "--out", out, "--baseline", "decompose"]
    cli.main(args)
    old = TableSet(spark, out).pointer.last()
    make_bars(spark, rows[100:]).write.mode("append").parquet(bars)
    real = TableSet.write
    for fatal in ("forest", "baseline", "results"):
        def write(self, name, df, partition_by=None, fatal=fatal):
            if name == fatal:
                raise KeyboardInterrupt
            return real(self, name, df, partition_by)
        monkeypatch.setattr(TableSet, "write", write)
        with pytest.raises(KeyboardInterrupt):
            cli.main([*args, "--retrain"])
        assert TableSet(spark, out).pointer.last() == old and cli._models(spark, out).scaler.first()["n_rows"] == 51
    monkeypatch.setattr(TableSet, "write", real)
    cli.main([*args, "--retrain"])
    assert cli._models(spark, out).scaler.first()["n_rows"] == 61 and cli._results(spark, out).count() == 61
    capsys.readouterr()
