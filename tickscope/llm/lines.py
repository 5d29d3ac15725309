"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and are removed everywhere.

The spread of a line is its number of distinct sites. One HyperLogLog sketch of the sites a line hash is
built with map-side combine and merged in the shuffle, so a line on every page costs one small sketch a task. Where the estimate is
clearly above or below ``min_sites`` (by more than SURE standard errors of the sketch) it decides; the lines
near the threshold get an exact distinct count, again combined map-side.

A line is a text between line feeds, unchanged; lines of blanks alone are kept and not counted. Lines are known by
128 bits of hash.

Nulls: a null text has no lines and stays empty; a null site is a site of its own. A line repeated in a document
counts once a site and is removed at each place. Repeated documents each get their result. An empty table gives an
empty result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, row_key, stored
from .sharding import source_key

LG_K = 10
SURE = 3.5
#: Relative standard error of a sketch of 2 ** LG_K registers.
ERROR = 1.04 / 2 ** (LG_K / 2)


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines with at least ``min_sites`` distinct sites, from rows (h1, h2, site)."""
    keys = ["h1", "h2"]
    spread = lines.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    margin = max(1.0, SURE * ERROR * min_sites)
    # tables of their own, small beside the lines: the joins with all lines then can be split where a line is very frequent
    spread = stored(spread.filter(F.col("sites") >= max(1.0, min_sites - margin)))
    sure = spread.filter(F.col("sites") > min_sites + margin).select(*keys)
    near = spread.filter(F.col("sites") <= min_sites + margin).select(*keys)
    exact = lines.join(near, keys, "left_semi").select(*keys, "site").distinct().groupBy(*keys).count().filter(F.col("count") >= min_sites)
    return stored(sure.unionAll(exact.select(*keys)))


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row a document: id, n_lines, n_removed, kept (the kept lines joined by line feeds; null text: null)."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), row_key(col(id_col), col(text_col)).alias("key"))
    named = docs.select(row_key(col(id_col), col(text_col)).alias("key"), source_key(col(site_col)).alias("site"), F.posexplode(F.split(col(text_col), "\n")).alias("at", "line"))
    lines = named.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("key", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    common = boilerplate(lines.select("h1", "h2", "site"), min_sites)
    gone = lines.select("key", "at", "h1", "h2").join(common, ["h1", "h2"], "left_semi").groupBy("key").agg(F.collect_set("at").alias("gone"))
    last = rows.join(gone, "key", "left").select("id", "text", "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, gone = text.split("\n") if text is not None else [], set(gone or ())
                total.append(len(parts))
                removed.append(len(gone))
                kept.append(None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_lines", "n_removed", "kept"])
    kind = docs.schema[id_col].dataType.simpleString()
    return last.mapInArrow(clean, f"`{id_col}` {kind}, n_lines bigint, n_removed bigint, kept string")
