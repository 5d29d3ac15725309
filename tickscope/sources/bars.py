"""Bar sources and sinks.

The engine works on one long table ``bars(ticker, Date, Open, High, Low, Close,
Volume)``. Tick or line-item tables become bars through a partial-aggregated
``groupBy`` (hot series are fine: each task pre-aggregates before the shuffle).
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import KEY, OHLCV, TIME


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bars_from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Tick table -> OHLCV bars per (event_type, time bucket).

    Open/Close are the values at the first/last tick of the bucket, Volume the tick count.
    """
    bucket = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return (events.select("event_type", "ts", "value")
            .groupBy(F.col("event_type").alias(KEY), bucket.alias(TIME))
            .agg(F.min_by("value", "ts").alias("Open"),
                 F.max("value").alias("High"),
                 F.min("value").alias("Low"),
                 F.max_by("value", "ts").alias("Close"),
                 F.count(F.lit(1)).cast("double").alias("Volume")))


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars per return flag: price = extended price / quantity.

    Dates carry no time, so order inside a day is the line key (unique at all scales).
    """
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    order = F.struct(*[F.col(c) for c in _LINE_ORDER])
    return (lineitem.select("l_returnflag", "l_shipdate", "l_quantity", *_LINE_ORDER)
            .groupBy(F.col("l_returnflag").alias(KEY),
                     F.col("l_shipdate").cast("timestamp_ntz").alias(TIME))
            .agg(F.min_by(price, order).alias("Open"),
                 F.max(price).alias("High"),
                 F.min(price).alias("Low"),
                 F.max_by(price, order).alias("Close"),
                 F.sum("l_quantity").cast("double").alias("Volume")))


def bars_from_brands(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Wider daily ticker set: one series per part brand (join on part key)."""
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    order = F.struct(*[F.col(c) for c in _LINE_ORDER])
    joined = (lineitem.select("l_partkey", "l_shipdate", "l_quantity", *[c for c in _LINE_ORDER if c != "l_partkey"])
              .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"))
    return (joined.groupBy(F.col("p_brand").alias(KEY), F.col("l_shipdate").cast("timestamp_ntz").alias(TIME))
            .agg(F.min_by(price, order).alias("Open"), F.max(price).alias("High"),
                 F.min(price).alias("Low"), F.max_by(price, order).alias("Close"),
                 F.sum("l_quantity").cast("double").alias("Volume")))


CSV_FILE = r"^(.*)_raw\.csv$"


def unique_bars(bars: DataFrame, version: str | None = None) -> DataFrame:
    """One bar a (ticker, Date): of several the one of the greatest ``version`` (a column; then left out), ties
    by the greatest values, so the choice never depends on the order of rows."""
    value = F.struct(*OHLCV)
    order = value if version is None else F.struct(F.col(version), value)
    return bars.groupBy(KEY, TIME).agg(F.max_by(value, order).alias("v")).select(KEY, TIME, "v.*")


#: Cells that count as missing (fixed values: the usual spellings of a missing number in CSV files).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"
#: Headers that a folder of bar files may have; they come to the driver.
MAX_HEADERS = 1000


def bar_lines(reader, path: str):
    """Lines of ``{ticker}_raw.csv`` files with their file and its time (``reader``: spark.read or spark.readStream)."""
    return reader.text(path).select("value", F.col("_metadata.file_name").alias("file"),
                                    F.col("_metadata.file_modification_time").alias("version"))


def header_catalogue(lines: DataFrame) -> tuple[DataFrame, list[int]]:
    """(file, cells, at) of every file with a header, and the distinct numbers of cells: where each bar column stands
    in the file's own header. Each distinct header is parsed once."""
    spark = lines.sparkSession
    # a header names all bar columns
    is_head = reduce(and_, [F.col("value").rlike(f'(^|,)\\s*"?{c}"?\\s*(,|$)') for c in [TIME, *OHLCV]])
    heads = lines.filter(is_head).groupBy("file").agg(F.min("value").alias("head"))
    found = [r["head"] for r in heads.select("head").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(found) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    rows = []
    for head in found:
        names = [c.strip() for c in next(csv.reader([head]))]
        rows.append((head, len(names), [names.index(c) for c in [TIME, *OHLCV]]))
    layouts = spark.createDataFrame(rows, "head string, cells int, at array<int>")
    return heads.join(F.broadcast(layouts), "head").select("file", "head", "cells", "at"), sorted({r[1] for r in rows})


def parse_bar_lines(lines: DataFrame) -> DataFrame:
    """Bars (and ``version``) from CSV lines: columns are found by their names in each file's own header, in any order.

    Lines are taken apart by Spark's CSV parser with the usual quoting (a doubled quote inside quotes); files whose
    headers are equally wide go through one parser. A line with more or fewer cells than its header, a cell
    that is no number and not one of MISSING, a time that is none, and a file without header are errors: a file is taken as a whole or refused.
    """
    plain = lines.withColumn("value", F.regexp_replace("value", r"^\ufeff|[\r\n]+$", "")).filter("trim(value) <> ''")
    heads, widths = header_catalogue(plain)
    rows = plain.join(heads, "file", "left").filter("head is null or value <> head")
    options = {"mode": "FAILFAST", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    cells = F.raise_error(F.concat(F.lit(f"no header with {', '.join([TIME, *OHLCV])} in "), F.col("file"))).cast("array<string>")
    for n in widths:
        names = [f"c{i}" for i in range(n)]
        # a struct is parsed once and then read by place
        parsed = F.from_csv("value", ", ".join(f"{c} string" for c in names), options)
        cells = F.when(F.col("cells") == n, F.transform(F.array(parsed), lambda r: F.array(*[r[c] for c in names]))[0]).otherwise(cells)  # noqa: B023
    split = rows.select("file", "version", "at", cells.alias("row"))

    def cell(k: int) -> Column:
        text = F.trim(F.get("row", F.get("at", F.lit(k))))
        return F.when(text.isin(MISSING), None).otherwise(text)

    def number(k: int) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{OHLCV[k - 1]} is no number in "), F.col("file"), F.lit(": "), cell(k)))
        return F.when(cell(k).isNull() | cell(k).rlike(NUMBER), cell(k)).otherwise(bad.cast("string")).cast("double")
    values = [number(k).alias(c) for k, c in enumerate(OHLCV, 1)]
    return split.select(F.regexp_extract("file", CSV_FILE, 1).alias(KEY), cell(0).cast("timestamp_ntz").alias(TIME), *values, "version")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read ``{ticker}_raw.csv`` files: ticker from the file name, columns by name, fail fast, one bar a time."""
    return unique_bars(parse_bar_lines(bar_lines(spark.read, path)), "version")


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per ticker; re-writing a ticker replaces only that ticker."""
    (bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(KEY).format(fmt).option("header", True).save(path))


def date_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Start inclusive, end exclusive; the predicate reaches the parquet scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(TIME) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (F.col(TIME) < F.lit(end).cast("timestamp_ntz"))
    return bars.filter(cond)


def load_status(spark: SparkSession, bars: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """Requested tickers with their row counts; a ticker without data is reported failed."""
    wanted = spark.createDataFrame([(t,) for t in tickers], f"{KEY} string")
    counts = bars.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    return (wanted.join(counts, KEY, "left")
            .select(KEY, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.col("n_rows").isNotNull().alias("ok")))


def recent_bars(bars: DataFrame, n_bars: int | None = None, days: int | None = None) -> DataFrame:
    """Last ``n_bars`` bars per ticker, or bars within ``days`` of the ticker's last bar."""
    if days is not None:
        last = bars.groupBy(KEY).agg(F.max(TIME).alias("_last"))
        return (bars.join(last, KEY)
                .filter(F.col(TIME) >= F.col("_last") - F.make_interval(days=F.lit(days)))
                .drop("_last"))
    w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_bars).drop("_rn")
