"""Written intermediate tables in the shared checkpoint folder.

Multi-pass algorithms (baseline fit, scaler, forest, dashboard queries over the
detection results) read their input several times. Instead of re-deriving it
from the source each time, the input is written once as parquet under
``spark.checkpoint.dir`` (shared storage on a cluster) and read back: this cuts
lineage, survives executor loss, and gives column pruning and ticker partition
pruning to every later pass.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..schemas import KEY, TIME
from ..session import scratch_path

_MEMO: dict[tuple[int, str], str] = {}
_SCHEMAS: dict[tuple[int, str], object] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def write_once(spark: SparkSession, df: DataFrame, name: str, key: str,
               partition_by: str | None = KEY) -> str:
    """Write ``df`` once per (name, key) under the checkpoint folder; return its path."""
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    memo_key = (id(spark.sparkContext), f"{name}/{digest}")
    path = _MEMO.get(memo_key)
    if path is None:
        path = scratch_path(spark, name, digest)
        if not _exists(spark, path):
            if partition_by:
                writer = df.write.mode("overwrite").partitionBy(partition_by)
            else:
                writer = df.write.mode("overwrite")
            writer.parquet(path)
        _MEMO[memo_key] = path
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str, key: str,
                partition_by: str | None = KEY) -> DataFrame:
    """Write ``df`` once per (name, key) and return a DataFrame reading the table.

    One layout: a folder a ticker. Rows are range-partitioned by (ticker, Date) first, so a task writes to few
    folders and a long series is split over tasks."""
    order = [c for c in (KEY, TIME, "t") if c in df.columns]
    path = write_once(spark, df.repartitionByRange(*order) if partition_by and order else df, name, key, partition_by)
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    _SCHEMAS[(id(spark.sparkContext), f"{name}/{digest}")] = df.schema
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def lookup(spark: SparkSession, name: str, key: str) -> DataFrame | None:
    """The table written for (name, key) in this session, if any."""
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    memo_key = (id(spark.sparkContext), f"{name}/{digest}")
    if memo_key in _MEMO and memo_key in _SCHEMAS:
        schema = _SCHEMAS[memo_key]
        return spark.read.schema(schema).parquet(_MEMO[memo_key]).select(*schema.fieldNames())
    return None


def materialize_lazy(spark: SparkSession, build, name: str, key: str,
                     partition_by: str | None = KEY) -> DataFrame:
    """Like ``materialize`` but ``build()`` (which may assemble a large plan) only runs
    when the table is not written yet in this session."""
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    memo_key = (id(spark.sparkContext), f"{name}/{digest}")
    if memo_key in _MEMO and memo_key in _SCHEMAS:
        schema = _SCHEMAS[memo_key]
        return spark.read.schema(schema).parquet(_MEMO[memo_key]).select(*schema.fieldNames())
    df = build()
    out = materialize(spark, df, name, key, partition_by)
    _SCHEMAS[memo_key] = df.schema
    return out


def fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Names, lengths and times of the files of the source tables: changed input gives another key."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for table in tables:
        at = path(os.path.join(sf_dir, f"{table}.parquet"))
        fs = at.getFileSystem(conf)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("|".join(sorted(found)).encode()).hexdigest()[:16]


def table_key(spark: SparkSession, sf_dir: str, tables: list[str], *parts) -> str:
    return "|".join([sf_dir, fingerprint(spark, sf_dir, tables), *[str(p) for p in parts]])
