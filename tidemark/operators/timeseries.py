"""Tumbling windows per instrument, with late-data rules and stateless factors before and after."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import expression as X
from tidemark.functions.factors import Agg, Expr
from tidemark.functions.values import fail
from tidemark.operators.reactive import filter_ids
from tidemark.schema import need, need_id, need_new, need_time


def accept(df: DataFrame, id_column: str, dt_column: str, order_by: Sequence[str], late: str, observation: Observation | None = None) -> DataFrame:
    """Rows not older than the latest accepted one of their instrument.

    Dropped rows never raise the running maximum, so the maximum over all earlier rows serves.
    """
    if late == "none":  # the input is known to be in order: no window, no exchange
        return df
    if late not in ("reject", "drop"):
        raise ValueError("late must be reject, drop or none")
    before = Window.partitionBy(id_column).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    is_late = F.coalesce(F.col(dt_column) < F.max(dt_column).over(before), F.lit(False))
    df = df.withColumn("_late", is_late)
    if late == "reject":
        return df.where(F.when(F.col("_late"), fail("late row", "boolean")).otherwise(F.lit(True))).drop("_late")
    if observation is not None:
        df = df.observe(observation, F.count(F.when(F.col("_late"), 1)).alias("late_rows"))
    return df.where("not _late").drop("_late")


def timeseries(
    df: DataFrame, id_column: str, dt_column: str, window: str, aggs: Sequence[Agg], order_by: Sequence[str], late: str = "reject",
    pre: Sequence[Expr] = (), post: Sequence[Expr] = (), id_filter: Iterable[str] | None = None, observation: Observation | None = None,
) -> DataFrame:
    """id, window_start, window_end, the aggregates (double) and post factors; empty windows give no row.

    Aggregation is partial before its exchange, by instrument and window, so a busy instrument is
    spread over its windows.
    """
    need_id(df, id_column)
    need_time(df, dt_column)
    if not aggs:
        raise ValueError("at least one aggregate is needed")
    need_new([e.output for e in pre], df.columns)
    need_new([*(a.output for a in aggs), *(e.output for e in post)], [id_column, "window_start", "window_end"])
    df = accept(filter_ids(df, id_column, id_filter), id_column, dt_column, order_by, late, observation)
    for e in pre:
        df = df.withColumn(e.output, X.column(e.expression, df.schema))
    for a in aggs:
        need(df, a.column, "double", role="value column")
        if a.weight:
            need(df, a.weight, "double", role="weight column")
    order = F.struct(*[F.col(c) for c in order_by])
    out = df.groupBy(F.col(id_column), F.window(dt_column, window).alias("_w")).agg(*[a.build(order).alias(a.output) for a in aggs])
    out = out.select(id_column, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[a.output for a in aggs])
    for e in post:
        out = out.withColumn(e.output, X.column(e.expression, out.schema))
    return out
