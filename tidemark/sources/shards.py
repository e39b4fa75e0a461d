"""Hash-sharded append tables: rows are split by key over physical shards and read as one table."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import shard
from tidemark.plans.table import Table
from tidemark.sources.tables import ROW_CAPACITY, append, read

SHARD = "shard"


class ShardedTable:
    """``shards`` folders ``shard=0000`` and on below ``path``; rows of equal keys share one.

    A write is not atomic over shards. Reads see all shards as one DataFrame, so plans apply to the whole; rows of one
    shard are read alone where its number is asked for (partition pruning).
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], shards: int | str = "auto"):
        if shards == "auto":
            shards = min(os.cpu_count() or 1, 16)
        if not isinstance(shards, int) or shards < 1:
            raise ValueError("at least one shard is needed")
        if not by:
            raise ValueError("at least one shard key is needed")
        self.spark, self.path, self.by, self.shards = spark, path.rstrip("/"), list(by), shards

    def split(self, df: DataFrame) -> DataFrame:
        """``df`` with the name of each row's shard."""
        if SHARD in df.columns:
            raise ValueError(f"column [{SHARD}] is taken")
        return shard(df, self.by, self.shards, SHARD).withColumn(SHARD, F.format_string("%04d", F.col(SHARD)))

    def write(self, df: DataFrame, row_capacity: int = ROW_CAPACITY) -> None:
        append(self.split(df).hint("rebalance", SHARD), self.path, row_capacity, [SHARD])

    def df(self, schema: T.StructType | None = None) -> DataFrame:
        return read(self.spark, self.path, schema).drop(SHARD)

    def shard(self, number: int) -> DataFrame:
        return read(self.spark, self.path).where(F.col(SHARD) == f"{number:04d}").drop(SHARD)

    def table(self, order_by: Sequence[str] = (), snapshot: bool = True) -> Table:
        return Table(self.df(), order_by, None if snapshot else self.df)

    def subscribe(self, *_, **__):
        raise ValueError("a sharded table can't be subscribed to as a whole: subscribe to its shards")
