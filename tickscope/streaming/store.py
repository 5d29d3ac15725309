"""Tables that a stream adds to: runs of files under one atomic pointer, merged on read.

A batch writes its rows of each table as a new folder (a run) and publishes all of them at once by one small file,
``_versions/<n>.json`` (``sources.pointer``), that names every run there is: a batch killed before that leaves the old state, and
its folders are never read. The pointer holds the last batch, so a replayed batch is recognised and adds nothing.

Rows carry ``batch_id``; of several rows of a key the newest batch's counts (``newest``). Runs are merged by size: ``fan`` runs of one
level become one of the next, so there are at most fan - 1 runs a level, logarithmically many in all, and each row is rewritten
once a level. Where a table's size is bounded by its keys (``whole``), all runs are merged at once. The pointer also
keeps each run's first and last time: a read of a date range opens only the runs that touch it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TIME
from ..sources.pointer import Pointer


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v"), F.max("batch_id").alias("batch_id")).select(*keys, "v.*", "batch_id")


class RunStore:
    def __init__(self, spark: SparkSession, folder: str, fan: int = 8):
        self.spark, self.folder, self.fan, self.pointer = spark, folder, fan, Pointer(spark, folder)

    def state(self) -> dict:
        """{"version", "batch", "tables": {name: [run]}}; batch is -1 and the tables are empty before the first one."""
        return self.pointer.last() or {"version": -1, "batch": -1, "tables": {}}

    def write(self, table: str, rows: DataFrame, batch: int, level: int = 0) -> dict | None:
        """Writes a run and describes it; None if it is empty. Not part of the table before ``publish``."""
        path = f"{table}/{batch}-{uuid.uuid4().hex[:12]}"
        if "batch_id" not in rows.columns:
            rows = rows.withColumn("batch_id", F.lit(batch).cast("long"))
        rows.write.parquet(f"{self.folder}/{path}")
        timed = TIME in rows.columns
        found = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{path}").agg(F.count("*"), *[f(TIME).cast("string") for f in ((F.min, F.max) if timed else ())]).first()
        if not found[0]:
            return None
        return {"path": path, "level": level, "rows": found[0], "first": found[1] if timed else None, "last": found[2] if timed else None}

    def publish(self, batch: int, added: dict[str, dict | None], replaced: dict[str, list[dict]] | None = None) -> dict:
        """The next state: ``added`` runs join their tables, the runs of ``replaced`` tables are the given ones."""
        state = self.state()
        tables = state["tables"] | (replaced or {})
        for table, run in added.items():
            tables[table] = tables.get(table, []) + ([run] if run else [])
        state = {"version": state["version"] + 1, "batch": batch, "tables": tables}
        self.pointer.publish(state["version"], state)
        return state

    def read(self, table: str, schema: T.StructType | str, first: dt.datetime | None = None, last: dt.datetime | None = None) -> DataFrame:
        """Rows of a table with ``batch_id``, of all batches; with times: of runs that touch [first, last], cut to it."""
        runs = self.state()["tables"].get(table, [])
        runs = [r for r in runs if (first is None or r["last"] is None or dt.datetime.fromisoformat(r["last"]) >= first)
                and (last is None or r["first"] is None or dt.datetime.fromisoformat(r["first"]) <= last)]
        return self.read_runs(runs, schema, first, last)

    def read_runs(self, runs: list[dict], schema: T.StructType | str, first: dt.datetime | None = None, last: dt.datetime | None = None) -> DataFrame:
        full = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField("batch_id", T.LongType())])
        if not runs:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(*[f"{self.folder}/{r['path']}" for r in runs])
        if first is not None:
            rows = rows.filter(F.col(TIME) >= F.lit(first).cast("timestamp_ntz"))
        return rows if last is None else rows.filter(F.col(TIME) <= F.lit(last).cast("timestamp_ntz"))

    def extent(self, table: str) -> tuple[dt.datetime, dt.datetime] | None:
        """First and last time of a table, from the pointer."""
        runs = self.state()["tables"].get(table, [])
        return (min(dt.datetime.fromisoformat(r["first"]) for r in runs), max(dt.datetime.fromisoformat(r["last"]) for r in runs)) if runs else None

    def compact(self, table: str, schema: T.StructType | str, keys: list[str], whole: bool = False) -> bool:
        """Merges runs as the module's text says; True if any were."""
        state = self.state()
        runs, merged = state["tables"].get(table, []), False
        while True:
            levels = [0] if whole else sorted({r["level"] for r in runs})
            full = next((lv for lv in levels if sum(whole or r["level"] == lv for r in runs) >= self.fan), None)
            if full is None:
                break
            old = [r for r in runs if whole or r["level"] == full]
            order = [k for k in (TIME, *keys) if k in keys]
            rows = newest(self.read_runs(old, schema), keys)
            run = self.write(table, rows.repartitionByRange(*order), state["batch"], 0 if whole else full + 1)
            runs, merged = [r for r in runs if r not in old] + ([run] if run else []), True
            if whole:
                break
        if merged:
            self.publish(state["batch"], {}, {table: runs})
        return merged

    def vacuum(self) -> int:
        """Deletes the folders that no kept pointer names; how many. Not while a batch is being written."""
        used = {r["path"] for name in self.pointer.names() for runs in self.pointer.load(name)["tables"].values() for r in runs}
        gone, fs = 0, self.pointer.fs
        for table in self.state()["tables"]:
            at = self.pointer.path(table)
            for status in fs.listStatus(at) if fs.exists(at) else []:
                if f"{table}/{status.getPath().getName()}" not in used:
                    gone += fs.delete(status.getPath(), True)
        return gone
