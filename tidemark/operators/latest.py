"""Latest rows by key, key-value changelogs, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import fail
from tidemark.schema import need_id


def _keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        raise ValueError("at least one key column is needed")
    for k in by:
        need_id(df, k)
    none = F.lit(False)
    for k in by:
        none = none | F.col(k).isNull()
    return df.where(F.when(none, fail("null key", "boolean")).otherwise(F.lit(True)))


#: types that a hash aggregate can hold; with others Spark sorts a task's rows by key first
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def latest(df: DataFrame, by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, so one row a key and task is shuffled; a null key fails.

    With one order column and, but for keys of text, columns of fixed width a task holds one row a key in a hash table. All
    columns come from one row then too, in ties as well: their aggregates see the same rows in the same order.
    """
    rows, kinds = _keys(df, by), dict(df.dtypes)
    text = [k for k in by if kinds[k] == "string"]
    if len(order_by) == 1 and len(kinds) == len(df.columns) and order_by[0] not in text and all(kinds[c] in _FIXED for c in df.columns if c not in text):
        order = F.col(f"`{order_by[0]}`")
        found = rows.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(by)]).agg(
            F.count(order).alias("_n"), *[a for i, c in enumerate(df.columns) if c not in text for a in (F.max_by(f"`{c}`", order).alias(f"_v{i}"), F.first(f"`{c}`").alias(f"_f{i}"))]
        )
        # an order that is null in all rows of a key: any row is the last
        return found.select(*[(F.col(f"_k{by.index(c)}") if c in text else F.when(F.col("_n") > 0, F.col(f"_v{i}")).otherwise(F.col(f"_f{i}"))).alias(c) for i, c in enumerate(df.columns)])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(F.max_by(whole, F.struct(*order_by)).alias("_row"))
    return last.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def changelog(df: DataFrame, by: Sequence[str], batch: str, order_by: Sequence[str]) -> DataFrame:
    """One upsert for each batch and key, numbered without gaps by batch, then key.

    Columns ``kv_seq``, ``kv_op``, ``kv_snapshot_version``, then the input's. Only the table of
    batches (one row each) is numbered in one place; rows are numbered within their batch.
    """
    rows = _keys(df, by)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = rows.groupBy(F.col(batch).alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(F.max_by(whole, F.struct(*order_by)).alias("_row"))
    keys = [f"_k{i}" for i in range(len(by))]
    order = Window.orderBy("_b")
    batches = last.groupBy("_b").agg(F.count("*").alias("_n")).select(
        F.col("_b").alias("_bb"), F.row_number().over(order).cast("long").alias("kv_snapshot_version"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    out = last.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*keys))).join(batches, F.col("_b").eqNullSafe(F.col("_bb")))
    return out.select((F.col("_before") + F.col("_rn")).cast("long").alias("kv_seq"), F.lit("upsert").alias("kv_op"), "kv_snapshot_version", *[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def shard(df: DataFrame, by: Sequence[str], shards: int, output: str = "shard") -> DataFrame:
    """``df`` and a shard number: equal keys share a shard. -0.0 counts as 0.0; null and NaN keys fail."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keys, bad = [], F.lit(False)
    for k in by:
        c = F.col(f"`{k}`")
        bad = bad | c.isNull()
        if df.schema[k].dataType.simpleString() in ("double", "float"):
            bad, c = bad | F.isnan(c), F.when(c == 0, F.lit(0.0)).otherwise(c)
        keys.append(c)
    return df.withColumn(output, F.when(bad, fail("null or NaN shard key", "int")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")))
