"""Named tables: list, describe, health, drop, compact."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables


class Catalog:
    """Names of append-table folders under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, name: str) -> int:
        return tables.partitions(self.spark, self.path(name)).agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]

    def list_tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def table_info(self, name: str) -> dict:
        df = tables.read(self.spark, self.path(name))
        fs, p = self._fs(self.path(name))
        total = fs.getContentSummary(p)
        return {"name": name, "schema": df.schema, "files": self._files(name), "bytes": int(total.getLength()), "rows": df.count()}

    def table_alerts(self, name: str, max_files: int = 1000, stale_seconds: float | None = None) -> list[str]:
        fs, p = self._fs(self.path(name))
        if not fs.exists(p):
            return ["missing"]
        out = []
        if self._files(name) > max_files:
            out.append("too many files")
        if stale_seconds is not None and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale_seconds:
            out.append("stale")
        return out

    def table_health(self, name: str, **limits) -> dict:
        alerts = self.table_alerts(name, **limits)
        return {"name": name, "healthy": not alerts, "alerts": alerts}

    def drop_table(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def compact_table(self, name: str, sort_by: list[str], min_files: int = 2) -> list[dict]:
        """What was merged, a row for each partition group."""
        return tables.compact(self.spark, self.path(name), sort_by, min_files)

    def compact_tables(self, sort_by: dict[str, list[str]], min_files: int = 2) -> dict[str, list[dict]]:
        return {name: self.compact_table(name, columns, min_files) for name, columns in sort_by.items()}
