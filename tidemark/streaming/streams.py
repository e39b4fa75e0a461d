"""Streams over append tables: windows, per-instrument state, latest rows, subscriptions, replay.

Windows close by the global watermark, so rows of a window appear later than a per-instrument rule
would give them; what appears is the same (``factors.accepted`` has the per-instrument rule). Order-dependent factors
are not SQL windows on a stream; ``stateful_ema`` here and ``factors.rolling`` hold the little state they need
per instrument instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.factors import Agg, ts_mean
from tidemark.session import ship
from tidemark.streaming.factors import rolling
from tidemark.streaming.ordered import in_order


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The files of an append table as a stream; ``files_per_trigger`` sets the pace."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def timeseries(df: DataFrame, id_column: str, dt_column: str, window: str, aggs: Sequence[Agg], order_by: Sequence[str], late_by: str) -> DataFrame:
    """Tumbling windows; rows later than ``late_by`` behind the newest are dropped and counted by Spark."""
    order = F.struct(*[F.col(c) for c in order_by])
    out = df.withWatermark(dt_column, late_by).groupBy(F.col(id_column), F.window(dt_column, window).alias("_w")).agg(*[a.build(order).alias(a.output) for a in aggs])
    return out.select(id_column, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[a.output for a in aggs])


def stateful_ema(df: DataFrame, id_column: str, value: str, span: int, order_by: Sequence[str], output: str) -> DataFrame:
    ship(df.sparkSession)
    names, alpha = list(df.columns), 2.0 / (span + 1)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [state.get[0]] if state.exists and state.get[0] is not None else []
        for rows in in_order(frames, order_by):
            x = rows[value].astype("float64").to_numpy()
            out = pd.Series(np.append(held, x)).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[len(held) :]
            held = [] if np.isnan(out[-1]) else [float(out[-1])]
            yield rows[names].assign(**{output: pd.Series(np.where(np.isnan(x), None, out), index=rows.index)})
        state.update((held[0] if held else None,))

    return df.groupBy(id_column).applyInPandasWithState(run, schema, "y double", "append", GroupStateTimeout.NoTimeout)


def stateful_mean(df: DataFrame, id_column: str, value: str, window: int, order_by: Sequence[str], output: str) -> DataFrame:
    return rolling(df, id_column, ts_mean(value, window, output), order_by)


def upsert_stream(df: DataFrame, table, checkpoint: str) -> StreamingQuery:
    """Feed a key-value table (``KeyValueTable``), one version for each micro-batch with rows; its only stream."""
    return df.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def persist_stream(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def subscribe_table(
    df: DataFrame, callback: Callable[[DataFrame], None], checkpoint: str, where=None, count: int | None = None, order_by: Sequence[str] = (), throttle: str | None = None,
    batch_size: int = 1, wait_seconds: float = 0.0,
) -> StreamingQuery:
    """Call back with filtered rows once ``batch_size`` have come or ``wait_seconds`` have passed since the last call;
    only with the last ``count`` of them if given. ``throttle`` is the time between batches, else all that is there is
    read and the query ends. Rows wait in the checkpoint's folder, a table for each micro-batch."""
    if count is not None and not order_by:
        raise ValueError("count needs order_by")
    waiting, last = f"{checkpoint.rstrip('/')}/waiting", [time.monotonic()]

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch if where is None else batch.where(where)
        if batch_size > 1:
            spark = batch.sparkSession
            rows.write.mode("overwrite").parquet(f"{waiting}/{epoch}")
            fs, p = _hadoop(spark, waiting)
            epochs = sorted(int(s.getPath().getName()) for s in fs.listStatus(p))
            rows = spark.read.schema(batch.schema).parquet(*[f"{waiting}/{e}" for e in epochs if e <= epoch])
            n = rows.count()
            if not n or n < batch_size and not (wait_seconds and time.monotonic() - last[0] >= wait_seconds):
                return
        elif rows.isEmpty():
            return
        callback(rows if count is None else rows.orderBy(*[F.col(c).desc() for c in order_by]).limit(count).orderBy(*order_by))
        last[0] = time.monotonic()
        if batch_size > 1:
            for e in epochs:
                fs.delete(_hadoop(spark, f"{waiting}/{e}")[1], True)

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=throttle) if throttle else writer.trigger(availableNow=True)).start()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def subscribe_key_value(df: DataFrame, table, checkpoint: str, on_snapshot: Callable[[DataFrame], None] | None = None, on_changes: Callable[[DataFrame], None] | None = None, start_from: int = -1) -> StreamingQuery:
    """Feed a key-value table and call back after every change: with the whole snapshot, or with the changed rows alone
    (without the changelog's own columns)."""
    if start_from != -1:
        raise ValueError("start_from must be -1 for a key-value table")
    if (on_snapshot is None) == (on_changes is None):
        raise ValueError("give one of on_snapshot and on_changes")

    def each(batch: DataFrame, epoch: int) -> None:
        before = table.version
        table.upsert(batch, epoch)
        if table.version == before:
            return
        if on_snapshot is not None:
            on_snapshot(table.snapshot())
        else:
            on_changes(table.changes().where(F.col("kv_snapshot_version") == table.version).drop("kv_seq", "kv_op", "kv_snapshot_version"))

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(df: DataFrame, on_row: Callable, checkpoint: str, instruments: Sequence[str] | None = None, id_column: str = "instrument_id", start_from: int = -1) -> StreamingQuery:
    """Call back with each row, on the executors."""
    if start_from != -1:
        raise ValueError("start_from must be -1: a stream starts at its checkpoint")
    rows = df if instruments is None else df.where(F.col(id_column).isin(list(instruments)))
    return rows.writeStream.foreach(on_row).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(df: DataFrame, table, on_rows: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """The latest row of every key seen so far, after each micro-batch with rows; ``table`` (``KeyValueTable``) holds them."""
    return subscribe_key_value(df, table, checkpoint, on_snapshot=on_rows)


class Replay:
    """Stored rows to one target once more: a callback, or a sink that takes a stream.

    ``files_per_batch`` and ``every`` set the pace; without them all is read as fast as it goes. A replay runs once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, callback: Callable[[DataFrame], None] | None = None, target: str | None = None, time_column: str | None = None, start=None, end=None, files_per_batch: int | None = None, every: str | None = None):
        if (callback is None) == (target is None):
            raise ValueError("a replay has one target: a callback or a table")
        if (start is not None or end is not None) and time_column is None:
            raise ValueError("start and end need a time column")
        self._df, self._how, self._query = source(spark, path, schema, files_per_batch), (checkpoint, callback, target, every), None
        for value, op in ((start, "__ge__"), (end, "__le__")):
            if value is not None:
                self._df = self._df.where(getattr(F.col(time_column), op)(F.lit(value)))

    def run(self) -> StreamingQuery:
        if self._query is not None:
            raise RuntimeError("a replay can't be started again")
        checkpoint, callback, target, every = self._how
        writer = self._df.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, _: callback(batch)) if callback else writer.format("parquet").option("path", target).outputMode("append")
        self._query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        return self._query


def live_health(q: StreamingQuery) -> dict:
    error = q.exception()
    return {"active": q.isActive, "failed": error is not None, "status": q.status["message"], "error": None if error is None else str(error)}


def raise_if_failed(q: StreamingQuery) -> None:
    if (error := q.exception()) is not None:
        raise error


def needs_rebuild(q: StreamingQuery) -> bool:
    """Whether the query has stopped by an error: a new one from its checkpoint has to take its place."""
    return not q.isActive and q.exception() is not None


def wait_healthy(q: StreamingQuery, seconds: float = 30.0, every: float = 0.1) -> dict:
    """Its health once it has made progress or ended; an error if it fails or the time is over."""
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        raise_if_failed(q)
        if q.lastProgress is not None or not q.isActive:
            return live_health(q)
        time.sleep(every)
    raise TimeoutError(f"no progress within {seconds} seconds")
