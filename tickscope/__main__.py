"""Command line: the reference's three entry points as Spark jobs.

  python -m tickscope detect --bars DIR --out DIR [--retrain] [--baseline decompose]
  python -m tickscope live   --bars DIR --out DIR [--once | --interval SECONDS]
  python -m tickscope alerts --out DIR [--bars DIR] [--live] [--lookback DAYS] [--as-of DATE]

``--bars`` holds ``{TICKER}_raw.csv`` files (or parquet bars with ``--parquet``); new bars of a live run arrive as new
files. ``--out`` receives the model tables (scaler, forest, baseline) and the partitioned results, published together. ``--as-of`` is the
run date, by default today.
"""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import functions as F

from .operators import alerts as A
from .operators import live as L
from .operators.detect import DetectParams, Models, detect, fit_and_detect, train_or_reuse
from .operators.portfolio import stored_thresholds
from .schemas import KEY, LIVE_LOOKBACK_DAYS
from .session import get_session
from .sources.bars import read_bars_csv, unique_bars
from .sources.pointer import TableSet
from .streaming.live_stream import read_bar_stream, start_live_scoring

TABLES = ("scaler", "forest", "baseline")


def _bars(spark, args):
    return unique_bars(spark.read.parquet(args.bars)) if args.parquet else read_bars_csv(spark, args.bars)


def _models(spark, out) -> Models | None:
    """The stored models, or None if there are none yet."""
    found = TableSet(spark, out).read(*TABLES)
    return Models(*found) if found else None


def _results(spark, out):
    found = TableSet(spark, out).read("results")
    if found is None:
        raise SystemExit(f"No results in {out}. Run detect first.")
    return found[0]


def cmd_detect(spark, args) -> None:
    """Models and results become visible together, by one pointer: a run that is killed leaves the old set."""
    bars = _bars(spark, args)
    params = DetectParams(baseline=args.baseline)
    stored, tables, written = _models(spark, args.out), TableSet(spark, args.out), {}

    def write(name, df):
        written[name] = tables.write(name, df)
        return tables.at(written[name])
    if stored is None or args.retrain:
        results = fit_and_detect(bars, params, store=write)[2]
    else:
        models = train_or_reuse(bars, stored, False, params)
        if models is not stored:
            models = Models(*[write(name, getattr(models, name)) for name in TABLES])
        results = detect(bars, params, models)
    written["results"] = tables.write("results", results, KEY)
    tables.publish(written)
    res = _results(spark, args.out)
    res.groupBy(KEY).agg(F.sum("if_anomaly").alias("IF"), F.sum("band_anomaly").alias("band"),
                         F.sum("consensus_anomaly").alias("consensus")).orderBy(KEY).show(truncate=False)


def cmd_live(spark, args) -> None:
    stored = _models(spark, args.out)
    if stored is None:
        print("No models loaded. Run detect first.")
        return
    thr = stored_thresholds(_results(spark, args.out))
    if args.once:
        scores = L.live_scores(_bars(spark, args), stored.scaler, stored.forest, thr, lookback_days=LIVE_LOOKBACK_DAYS)
        scores.orderBy(KEY).show(truncate=False)
        L.live_summary(scores).show(truncate=False)
        L.anomalous_tickers(scores).orderBy(KEY).show(truncate=False)
        return
    stream = read_bar_stream(spark, args.bars, fmt="parquet" if args.parquet else "csv")
    q = start_live_scoring(spark, stream, None, stored.scaler, stored.forest, thr,
                           os.path.join(args.out, "live"), os.path.join(args.out, "live_ckpt"),
                           available_now=args.available_now, processing_time=f"{args.interval} seconds")
    q.awaitTermination()


def cmd_alerts(spark, args) -> None:
    results = _results(spark, args.out)
    as_of = args.as_of or datetime.date.today().isoformat()

    def live():
        models = _models(spark, args.out)
        if models is None or not args.bars:
            raise SystemExit("Stored results are not fresh and live scoring needs --bars and stored models.")
        return L.live_scores(_bars(spark, args), models.scaler, models.forest, stored_thresholds(results), min_bars=0)
    flagged = A.alerts_auto(results, live, as_of, args.lookback, force_live=args.live)
    if not A.anything_to_send(flagged):
        print("No anomalies detected. No alert sent.")
        return
    A.alert_digest(flagged).show(truncate=False)
    A.alert_rows(flagged).orderBy(KEY, "Date").show(truncate=False)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tickscope")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("detect", "live", "alerts"):
        s = sub.add_parser(name)
        s.add_argument("--bars")
        s.add_argument("--out", required=True)
        s.add_argument("--parquet", action="store_true")
        if name == "detect":
            s.add_argument("--retrain", action="store_true")
            s.add_argument("--baseline", default="map", choices=["map", "decompose"])
        if name == "live":
            s.add_argument("--once", action="store_true")
            s.add_argument("--interval", type=int, default=300)
            s.add_argument("--available-now", action="store_true", dest="available_now")
        if name == "alerts":
            s.add_argument("--live", action="store_true")
            s.add_argument("--lookback", type=int, default=1)
            s.add_argument("--as-of", dest="as_of")
    args = p.parse_args(argv)
    spark = get_session()
    {"detect": cmd_detect, "live": cmd_live, "alerts": cmd_alerts}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
