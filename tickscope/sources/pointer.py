"""One atomic pointer for a folder of files, and sets of tables that change all at once.

A state is a small JSON file ``_versions/<n>.json``, written under another name and renamed; the last one counts. Readers see
the state before or after a change, never between, and what a killed writer left is named by no pointer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Pointers kept for readers that began before the last change.
KEPT_VERSIONS = 3


class Pointer:
    """States of a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.folder, self._path = folder, jvm.org.apache.hadoop.fs.Path
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self._path("/".join([self.folder, *parts]))

    def names(self) -> list[str]:
        at = self.path("_versions")
        if not self.fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(at)) if n.endswith(".json") and not n.startswith("."))

    def load(self, name: str) -> dict:
        stream = self.fs.open(self.path("_versions", name))
        try:
            return json.loads(self._text(stream))
        finally:
            stream.close()

    def last(self) -> dict | None:
        names = self.names()
        return self.load(names[-1]) if names else None

    def publish(self, version: int, state: dict) -> None:
        """Makes ``state`` the last one, as number ``version``; an error if that number is taken."""
        name, beside = self.path("_versions", f"{version:012d}.json"), self.path("_versions", f".{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(beside, name):
            raise RuntimeError(f"{name} is there already: two writers use {self.folder}")
        for old in self.names()[:-KEPT_VERSIONS]:
            self.fs.delete(self.path("_versions", old), False)


class TableSet:
    """Tables under one pointer: written each into a folder of its own, they take effect together by ``publish``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.pointer = spark, Pointer(spark, folder)

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> str:
        """Writes a table beside the published ones; its path under the folder."""
        path = f"{name}/{uuid.uuid4().hex[:12]}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.pointer.folder}/{path}")
        return path

    def at(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.pointer.folder}/{path}")

    def publish(self, written: dict[str, str]) -> None:
        """The given tables replace those of their names, the others stay."""
        state = self.pointer.last() or {"version": -1, "tables": {}}
        self.pointer.publish(state["version"] + 1, {"version": state["version"] + 1, "tables": state["tables"] | written})

    def read(self, *names: str) -> list[DataFrame] | None:
        """The published tables of one state, or None if one of them was never published."""
        tables = (self.pointer.last() or {"tables": {}})["tables"]
        return [self.at(tables[n]) for n in names] if all(n in tables for n in names) else None
