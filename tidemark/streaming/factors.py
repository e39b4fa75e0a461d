"""Order-dependent factors and engines on streams.

Rolling factors hold the last valid values of each instrument; cross-sections and bars are computed by their batch
operators over the rows that a micro-batch completes, with the rows of what is still open kept as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.factors import Cross, Factor
from tidemark.functions.values import SENTINEL
from tidemark.operators.bars import MINUTE, Profile, bars
from tidemark.operators.cross_section import cross_section
from tidemark.session import ship
from tidemark.streaming.ordered import in_order

ROLLING = ("TS_MEAN", "TS_STD", "TS_DELAY", "TS_DIFF", "TS_RETURN")
#: windows of more values have running deviations
DIRECT = 256


def _rolled(kind: str, values: pd.Series, n: int) -> pd.Series:
    """The factor over valid values in order."""
    if kind == "TS_MEAN":
        return values.rolling(n).mean()
    if kind == "TS_STD":
        if n > DIRECT or n > len(values):
            return values.rolling(n).std(ddof=0)
        # each window by itself: a running deviation drifts with the rows before, which shows in the sixth place
        own = np.lib.stride_tricks.sliding_window_view(values.to_numpy(), n).std(axis=1)
        return pd.Series(np.append(np.full(n - 1, np.nan), own))
    before = values.shift(n)
    if kind == "TS_DELAY":
        return before
    if kind == "TS_DIFF":
        return values - before
    with np.errstate(all="ignore"):
        ratio = values / before - 1.0
    return ratio.where(np.isfinite(ratio))


def rolling(df: DataFrame, id_column: str, factor: Factor, order_by: Sequence[str]) -> DataFrame:
    """``df`` and a rolling factor; invalid values give null and leave the history as it is. Rows of one instrument are in
    order within and over micro-batches."""
    if factor.kind not in ROLLING:
        raise ValueError(f"{factor.kind} is not a rolling factor")
    ship(df.sparkSession)
    keep = factor.size - 1 if factor.kind in ("TS_MEAN", "TS_STD") else factor.size
    names = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(factor.output, T.DoubleType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], "float64")
        for rows in in_order(frames, order_by):
            x = rows[factor.column].astype("float64")
            ok = np.isfinite(x) & (x.abs() < SENTINEL)
            values = pd.Series(np.append(held, x[ok]))
            out = pd.Series(np.nan, index=rows.index, dtype="float64")
            out[ok] = _rolled(factor.kind, values, factor.size).to_numpy()[len(held) :]
            held = values.tail(keep).to_numpy() if keep else held
            yield rows[names].assign(**{factor.output: out.astype(object).where(out.notna(), None)})
        state.update((held.tolist(),))

    return df.groupBy(id_column).applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def accepted(df: DataFrame, id_column: str, dt_column: str, order_by: Sequence[str]) -> DataFrame:
    """Rows not older than the latest accepted one of their instrument, over the whole stream; late ones are dropped."""
    ship(df.sparkSession)
    names = list(df.columns)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else np.iinfo("int64").min
        for rows in in_order(frames, order_by):
            at = rows[dt_column].to_numpy("datetime64[us]").astype("int64")
            seen = np.maximum.accumulate(np.append(newest, at))
            newest = seen[-1]
            yield rows[names][at >= seen[:-1]]
        state.update((int(newest),))

    return df.groupBy(id_column).applyInPandasWithState(run, df.schema, "seen bigint", "append", GroupStateTimeout.NoTimeout)


class Windowed:
    """Feeds a batch operator by whole buckets: ``each`` is a ``foreachBatch`` function.

    Rows of the newest bucket wait in a table under ``path`` until a row of a later bucket arrives, or ``flush`` is called.
    Versions of that table are numbered by epoch, so a batch that comes again after a failure reads what it read before.
    """

    def __init__(self, path: str, bucket: Callable[[DataFrame], DataFrame], operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], fail_late: bool = False):
        self.path, self.bucket, self.operator, self.sink, self.fail_late = path.rstrip("/"), bucket, operator, sink, fail_late

    def _waiting(self, spark, epoch: int) -> DataFrame | None:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{epoch}/_SUCCESS")
        return spark.read.parquet(f"{self.path}/{epoch}") if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None

    def each(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = self._waiting(spark, epoch - 1)
        if held is not None and self.fail_late:
            open_bucket = held.agg(F.min("_bucket")).first()[0]
            if open_bucket is not None and not self.bucket(batch).where(F.col("_bucket") < open_bucket).isEmpty():
                raise ValueError("late row: its bucket is closed")
        rows = self.bucket(batch) if held is None else held.unionByName(self.bucket(batch))
        newest = rows.agg(F.max("_bucket")).first()[0]
        if newest is None:
            rows.write.mode("overwrite").parquet(f"{self.path}/{epoch}")
            return
        rows.where(F.col("_bucket") == F.lit(newest)).write.mode("overwrite").parquet(f"{self.path}/{epoch}")
        closed = rows.where(F.col("_bucket") < F.lit(newest)).drop("_bucket")
        if not closed.isEmpty():
            self.sink(self.operator(closed), epoch)
        self.last = epoch

    def flush(self, spark) -> None:
        """What still waits is complete."""
        held = self._waiting(spark, self.last)
        if held is not None and not held.isEmpty():
            self.sink(self.operator(held.drop("_bucket")), self.last + 1)

    def start(self, df: DataFrame, checkpoint: str) -> StreamingQuery:
        return df.writeStream.foreachBatch(self.each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cross_sections(path: str, id_column: str, dt_column: str, interval: str, factors: Sequence[Cross], order_by: Sequence[str], sink: Callable[[DataFrame, int], None]) -> Windowed:
    """Cross-sections of each bucket once a later one begins; a row of a bucket that is closed is an error."""
    return Windowed(path, lambda df: df.withColumn("_bucket", F.window(dt_column, interval)["start"]), lambda df: cross_section(df, id_column, dt_column, interval, factors, order_by), sink, fail_late=True)


def bar_stream(path: str, profile: Profile, order_by: Sequence[str], sink: Callable[[DataFrame, int], None]) -> Windowed:
    """Bars of increments (``delta`` volume) by minute, once a later minute begins; auctions are dropped or separate.

    Totals of the day and merged auctions need ticks of closed minutes and are computed in batch.
    """
    if profile.volume.mode != "delta" or profile.auction == "merge_to_first_regular_bar":
        raise ValueError("bars on a stream take delta volume and no merged auctions")

    def bucket(df: DataFrame) -> DataFrame:
        start = F.col(profile.columns.dt)
        if profile.auction == "emit_separate_bar":  # an auction is open for hours: a day is the unit
            return df.withColumn("_bucket", F.date_trunc("day", start))
        return df.withColumn("_bucket", F.window(start, f"{MINUTE} seconds")["start"])

    return Windowed(path, bucket, lambda df: bars(df, profile, order_by), sink)
