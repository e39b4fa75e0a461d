"""Cross-sectional factors over time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.factors import Cross
from tidemark.schema import need, need_id, need_new, need_time


def _valid(column: str) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _rank(x: Column, nulls_last: bool) -> Column:
    """The average rank of ties."""
    if nulls_last:
        ties = F.count(F.lit(1)).over(Window.partitionBy("_bucket", x))
        return F.rank().over(Window.partitionBy("_bucket").orderBy(x.asc_nulls_last())) + (ties - 1) / 2.0
    ties = F.count(x).over(Window.partitionBy("_bucket", x))
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy("_bucket", x.isNotNull()).orderBy(x)) + (ties - 1) / 2.0)


def last_per_bucket(df: DataFrame, id_column: str, dt_column: str, interval: str, order_by: Sequence[str]) -> DataFrame:
    """The last row of every instrument in every bucket; ``_bucket`` is the bucket's start."""
    rows = df.withColumn("_bucket", F.window(dt_column, interval)["start"])
    order = F.struct(*[F.col(c) for c in order_by])
    last = rows.groupBy("_bucket", F.col(id_column).alias("_id")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row"))
    return last.select("_bucket", *[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def _last_values(df: DataFrame, id_column: str, dt_column: str, interval: str, factors: Sequence[Cross], order_by: Sequence[str]) -> DataFrame:
    """The last valid value of every factor's column, for each instrument and bucket."""
    rows = df.withColumn("_bucket", F.window(dt_column, interval)["start"])
    order = F.struct(*[F.col(c) for c in order_by])
    last = [F.max_by(_valid(f.column), F.when(_valid(f.column).isNotNull(), order)).alias(f"_x{i}") for i, f in enumerate(factors)]
    return rows.groupBy("_bucket", F.col(f"`{id_column}`").alias("_id")).agg(*last)


def cross_section(df: DataFrame, id_column: str, dt_column: str, interval: str, factors: Sequence[Cross], order_by: Sequence[str], last: str = "row") -> DataFrame:
    """id, dt (the bucket's start) and the factors, over the last row of each instrument in the bucket (``last="row"``), or
    over the last valid value of each factor's column (``last="value"``)."""
    if last not in ("row", "value"):
        raise ValueError("last must be row or value")
    need_id(df, id_column)
    need_time(df, dt_column)
    if not factors:
        raise ValueError("at least one factor is needed")
    need_new([f.output for f in factors], [id_column, dt_column])
    for f in factors:
        need(df, f.column)
    if last == "value":
        rows = _last_values(df, id_column, dt_column, interval, factors, order_by)
    else:
        rows = last_per_bucket(df, id_column, dt_column, interval, order_by)
        rows = rows.select(F.col(f"`{id_column}`").alias("_id"), "_bucket", *[_valid(f.column).alias(f"_x{i}") for i, f in enumerate(factors)])
    moments = [i for i, f in enumerate(factors) if f.kind != "RANK"]
    if moments:  # one row a bucket, partially aggregated; Spark broadcasts it where it is small
        stats = rows.groupBy("_bucket").agg(*[a for i in moments for a in (F.avg(f"_x{i}").alias(f"_m{i}"), F.stddev_pop(f"_x{i}").alias(f"_s{i}"))])
        rows = rows.join(stats, "_bucket")

    def value(i: int, f: Cross) -> Column:
        x = F.col(f"_x{i}")
        if f.kind == "RANK":
            return _rank(x, f.nulls_last)
        rest = x - F.col(f"_m{i}")
        return rest if f.kind == "DEMEAN" else F.when(x.isNotNull(), F.when(F.col(f"_s{i}") == 0, F.lit(0.0)).otherwise(rest / F.col(f"_s{i}")))

    return rows.select(F.col("_id").alias(id_column), F.col("_bucket").alias(dt_column), *[value(i, f).alias(f.output) for i, f in enumerate(factors)])
