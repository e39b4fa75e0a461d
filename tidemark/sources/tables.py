"""Append tables and key-value tables as parquet folders.

A folder is written with Spark's commit protocol and read as a whole; partitions are
``dt_part=<...>/<id>=<...>``, in UTC, and keep their values as text.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import fail
from tidemark.operators.latest import latest
from tidemark.schema import SchemaMismatch, need_id, need_time, same

ROW_CAPACITY = 65_536
#: dt_part format -> Spark pattern
PARTS = {"%Y": "yyyy", "%Y%m": "yyyyMM", "%Y%m%d": "yyyyMMdd", "%Y%m%d%H": "yyyyMMddHH"}
_STORED = {"bigint", "double", "string", "timestamp", "timestamp_ntz"}


def from_values(spark: SparkSession, values: Any, schema: T.StructType | None = None) -> DataFrame:
    """A dict (of lists, or one row), a list of dicts, an Arrow table or batch, or what has ``to_arrow``."""
    if hasattr(values, "to_arrow"):
        values = values.to_arrow()
    if isinstance(values, pa.RecordBatch):
        values = pa.Table.from_batches([values])
    if isinstance(values, Mapping):
        first = next(iter(values.values()), None)
        values = pa.table(dict(values)) if isinstance(first, (list, tuple, pa.Array)) else [dict(values)]
    if isinstance(values, pa.Table):
        return spark.createDataFrame(values, schema) if schema else spark.createDataFrame(values)
    rows = [dict(v) for v in values]
    return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)


def _storable(df: DataFrame) -> None:
    for f in df.schema:
        if f.dataType.simpleString() not in _STORED:
            raise SchemaMismatch(f"column [{f.name}] of type {f.dataType.simpleString()} can't be stored")


def append(df: DataFrame, path: str, row_capacity: int = ROW_CAPACITY, partition_by: Sequence[str] = ()) -> None:
    """Add rows; a file holds ``row_capacity`` rows at most."""
    _storable(df)
    writer = df.write.mode("append").option("maxRecordsPerFile", row_capacity)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def persist(df: DataFrame, path: str, dt_column: str | None = None, dt_part: str | None = None, id_column: str | None = None, row_capacity: int = ROW_CAPACITY) -> None:
    """Append by time part and instrument. Null partition values fail."""
    if (dt_column is None) != (dt_part is None):
        raise ValueError("dt_column and dt_part need each other")
    parts = []
    if dt_part is not None:
        if dt_part not in PARTS:
            raise ValueError(f"dt_part [{dt_part}] is not one of {', '.join(PARTS)}")
        need_time(df, dt_column)
        df = df.withColumn("dt_part", F.when(F.col(dt_column).isNull(), fail("null partition time", "string")).otherwise(F.date_format(dt_column, PARTS[dt_part])))
        parts.append("dt_part")
    if id_column is not None:
        need_id(df, id_column)
        df = df.withColumn(id_column, F.when(F.col(id_column).isNull(), fail("null partition key", "string")).otherwise(F.col(id_column)))
        parts.append(id_column)
    if parts:  # a partition's rows come from few tasks, so it gets few files; a large one is split by AQE
        df = df.hint("rebalance", *parts)
    append(df, path, row_capacity, parts)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition levels, from the first folder of each."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    while True:
        parts = [s.getPath() for s in fs.listStatus(here) if s.isDirectory() and "=" in s.getPath().getName()]
        if not parts:
            return out
        out.append(parts[0].getName().partition("=")[0])
        here = parts[0]


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Partition values stay text ('000001' isn't 1)."""
    if schema is None and (parts := partition_columns(spark, path)):
        inferred = spark.read.parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in parts else f for f in inferred])
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """One row a partition group (folder): path, files, bytes. Spark lists the files; no list reaches the driver."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def compact(spark: SparkSession, path: str, sort_by: Sequence[str], min_files: int = 2, max_groups: int = 1000) -> list[dict]:
    """Merge every partition group of ``min_files`` or more files into few, sorted by ``sort_by``.

    A group is written beside its folder and takes its place by one rename of folders; so readers see the old or the
    new group, but for the moment between two renames. Groups are handled ``max_groups`` at most a call, those of most
    files first (call again for more). Gives for each: folder, files and rows before and after, least and greatest
    values of the first sort column.
    """
    done = []
    for g in partitions(spark, path).where(F.col("files") >= min_files).orderBy(F.desc("files"), "folder").limit(max_groups).collect():
        folder, new = g["folder"], f"{path.rstrip('/')}.compact-{time.time_ns()}"
        rows = spark.read.parquet(folder)
        rows.hint("rebalance").sortWithinPartitions(*sort_by).write.parquet(new)
        out = spark.read.parquet(new)
        facts = out.agg(F.count(F.lit(1)).alias("rows"), F.min(sort_by[0]).alias("least"), F.max(sort_by[0]).alias("greatest")).first()
        if facts["rows"] != rows.count():
            raise OSError(f"{folder} changed while it was merged")
        swap(spark, folder, new)
        after = partitions(spark, folder).agg(F.sum("files")).first()[0]
        done.append({"folder": folder, "files_before": g["files"], "files_after": after, "rows": facts["rows"], "least": facts["least"], "greatest": facts["greatest"]})
    return done


def retain(spark: SparkSession, path: str, keep: int) -> int:
    """Delete all but the ``keep`` greatest values of the first partition level; gives the number deleted."""
    if keep < 1:
        raise ValueError("at least one partition is kept")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()), key=lambda x: x.getName())
    for old in folders[: max(0, len(folders) - keep)]:
        fs.delete(old, True)
    return max(0, len(folders) - keep)


def swap(spark: SparkSession, path: str, new: str, keep_old: bool = False) -> None:
    """Rename ``new`` to ``path``; the old folder moves aside first and is deleted last."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, there = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{time.time_ns()}")
    fs = here.getFileSystem(conf)
    fs.rename(here, old)
    if not fs.rename(there, here):
        fs.rename(old, here)
        raise OSError(f"can't move {new} to {path}")
    if not keep_old:
        fs.delete(old, True)


def replay(spark: SparkSession, paths: str | Iterable[str], time_column: str | None = None, start: Any = None, end: Any = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of parquet files, cast to ``schema`` if given, between start and end (both included)."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else list(paths)))
    if schema is not None:
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise SchemaMismatch(f"missing columns: {', '.join(missing)}")
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    if (start is not None or end is not None) and time_column is None:
        raise ValueError("start and end need a time column")
    if start is not None:
        df = df.where(F.col(time_column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time_column) <= F.lit(end))
    return df


class KeyValueTable:
    """Latest row of each key with a changelog, over versioned folders.

    ``upsert`` takes one batch: it appends its changes to the changelog and writes the next snapshot.
    A version counts once its snapshot is complete, and the folder's name tells the last epoch in it. So a
    table opened again goes on from there: what an unfinished version left is replaced, and a batch of
    a stream that comes again after a failure (its epoch is not past the last one) is skipped.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], order_by: Sequence[str]):
        self.spark, self.path, self.by, self.order_by = spark, path.rstrip("/"), list(by), list(order_by)
        self.version, self.epoch, self.next_seq = max(self._complete(), default=(0, -1)) + (1,)
        if self.version:
            self.next_seq = self._log(self.version).agg(F.max("kv_seq")).first()[0] + 1

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self) -> list[tuple[int, int]]:
        fs, p = self._hadoop(f"{self.path}/snapshot")
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [f.getName() for f in found if fs.exists(self._hadoop(f"{f}/_SUCCESS")[1])]
        return [(int(v), int(e)) for v, _, e in (name.partition("e") for name in done)]

    def _snapshot(self, version: int, epoch: int) -> str:
        return f"{self.path}/snapshot/{version}e{epoch}"

    def _log(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changelog/kv_part={version}")

    def upsert(self, batch: DataFrame, epoch: int | None = None) -> None:
        """``epoch`` numbers the batches of the one stream that feeds the table; other batches have none.

        Changes are numbered by key without a task that sees them all: they are dealt by ranges of keys and
        written, and only the number of rows of each range is summed up in one place.
        """
        if epoch is not None and epoch <= self.epoch:
            return
        changes, version, stage = latest(batch, self.by, self.order_by), self.version + 1, f"{self.path}/stage"
        changes.repartitionByRange(*self.by).sortWithinPartitions(*self.by).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(stage)
        staged = self.spark.read.parquet(stage).withColumn("_range", F.shiftright("_at", 33))  # the id is the partition, then 33 bits of row
        n = staged.count()
        if not n:
            return
        sizes = staged.groupBy("_range").agg(F.count("*").alias("_n"))
        before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        seq = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + self.next_seq
        numbered = staged.join(F.broadcast(before), "_range").select(  # one row a partition
            seq.cast("long").alias("kv_seq"), F.lit("upsert").alias("kv_op"), F.lit(version).cast("long").alias("kv_snapshot_version"), *[F.col(f"`{c}`") for c in changes.columns]
        )
        numbered.write.mode("overwrite").parquet(f"{self.path}/changelog/kv_part={version}")
        rows = self._log(version).drop("kv_seq", "kv_op", "kv_snapshot_version")
        now = rows if not self.version else rows.unionByName(self.snapshot().join(rows.select(*self.by), self.by, "left_anti"))
        epoch = self.epoch if epoch is None else epoch
        now.write.mode("overwrite").parquet(self._snapshot(version, epoch))
        self.version, self.epoch, self.next_seq = version, epoch, self.next_seq + n
        fs, p = self._hadoop(stage)
        fs.delete(p, True)
        for v, e in sorted(self._complete())[:-2]:  # the one before stays for its readers
            fs.delete(self._hadoop(self._snapshot(v, e))[1], True)

    def snapshot(self) -> DataFrame:
        return self.spark.read.parquet(self._snapshot(self.version, self.epoch))

    def changes(self) -> DataFrame:
        log = self.spark.read.option("basePath", f"{self.path}/changelog").parquet(f"{self.path}/changelog")
        return log.where(F.col("kv_part") <= self.version).drop("kv_part")


def fan_out(df: DataFrame, *sinks) -> None:
    """Each sink is called with the DataFrame."""
    for s in sinks:
        s(df)


def null_sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def replayed_equal(left: DataFrame, right: DataFrame) -> bool:
    return same(left.schema, right.schema) and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
