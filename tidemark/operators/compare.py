"""Comparison of two tables, and a digest that doesn't depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import same


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: schema_equal, data_equal, left_rows, right_rows, missing_rows, extra_rows, mismatch_rows.

    Rows count as often as they occur: each side's equal rows are counted before they meet.
    """
    if not same(left.schema, right.schema):
        rows = left.agg(F.count("*").alias("left_rows")).join(right.agg(F.count("*").alias("right_rows")), how="full", on=F.lit(True))
        return rows.select(F.lit(False).alias("schema_equal"), F.lit(False).alias("data_equal"), "left_rows", "right_rows", F.col("left_rows").alias("missing_rows"), F.col("right_rows").alias("extra_rows"), F.greatest("left_rows", "right_rows").alias("mismatch_rows"))
    names = [F.col(f"`{c}`") for c in left.columns]
    both = left.select(*names, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*names, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    by_row = both.groupBy(*names).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    total = by_row.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))), F.lit(0)).alias("missing_rows"), F.coalesce(F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))), F.lit(0)).alias("extra_rows"),
    )
    wrong = F.greatest("missing_rows", "extra_rows")
    return total.select(F.lit(True).alias("schema_equal"), (wrong == 0).alias("data_equal"), "left_rows", "right_rows", "missing_rows", "extra_rows", wrong.alias("mismatch_rows"))


def digest(df: DataFrame) -> DataFrame:
    """rows and a sum of row hashes: equal for equal multisets of rows."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
