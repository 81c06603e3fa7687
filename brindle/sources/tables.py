"""Named tables in one folder of any store: what the repositories of listings, tasks, predictions and releases need.

A table is a list of immutable parts; a numbered pointer names the parts of a version.  A version is seen once its pointer is
complete, so readers get the old or the new one whole, and a writer that dies leaves nothing that is seen.  One writer a table
is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.lifecycle import insert_new


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/pointers")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [x.getPath() for x in files.listStatus(folder)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in found if files.exists(done(p, "_SUCCESS")))

    def parts(self, name: str, version: int | None = None) -> list[str]:
        known = self.versions(name)
        if not known:
            return []
        return json.loads(self.spark.read.text(f"{self.root}/{name}/pointers/{version or known[-1]:012d}").first()["value"])

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest), empty if the table was never written."""
        parts = self.parts(name, version)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, before: list[str]) -> int:
        part = f"{self.root}/{name}/parts/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        version = max(self.versions(name), default=0) + 1
        self.spark.createDataFrame([(json.dumps([*before, part]),)], "value string").coalesce(1).write.text(f"{self.root}/{name}/pointers/{version:012d}")
        return version

    def replace(self, name: str, rows: DataFrame) -> int:
        """A version with these rows only; they may be read from the version before."""
        return self._write(name, rows, [])

    def append(self, name: str, rows: DataFrame, keys: Sequence[Sequence[str]] = (), order: Sequence[str] = ()) -> int:
        """A version with these rows added; rows whose key the table has, and later doubles, are left out."""
        stored = self.read(name, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
        return self._write(name, insert_new(rows, stored, keys, order) if keys else rows, self.parts(name))

    def upsert(self, name: str, rows: DataFrame, key: str) -> int:
        """A version in which these rows stand for stored ones of the same key."""
        stored = self.read(name, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
        return self.replace(name, stored.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows))
