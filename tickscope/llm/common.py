"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, scratch_path

#: Rows a batch handed to Python; with texts of some kB this keeps a batch at a few MB.
BATCH_ROWS = 1000
#: A word of the contracts, as a regular expression of Java and of DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Session set-up for the operators: shared checkpoint folder, small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (upper and lower case alike)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: Column, text: Column) -> Column:
    """Identity of a row for joins: rows of one id are apart unless their texts are equal too."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("\u0000")), F.coalesce(text, F.lit("\u0000\u0000")), id_col.isNull(), text.isNull())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := work(batch)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *extra: T.StructField) -> DataFrame:
    """``df.mapInArrow`` that keeps all columns, whatever their names, and appends ``extra``; ``run`` gives the columns in this order."""
    plain = [f"c{i}" for i in range(len(df.columns) + len(extra))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain)
    inside = df.toDF(*plain[:len(df.columns)])
    fields = [*inside.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(plain[len(df.columns):], extra)]]
    return inside.mapInArrow(named, T.StructType(fields)).toDF(*df.columns, *[f.name for f in extra])


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each row's list."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


def total_bytes(df: DataFrame, text_col: str) -> int:
    """Sum of the texts' UTF-8 lengths: one aggregate, one number."""
    return df.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors, is read by column."""
    path = scratch_path(df.sparkSession, "llm", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
