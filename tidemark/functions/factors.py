"""Specifications of factors and aggregates, named as users write them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Factor:
    """A per-instrument factor on one column: TS_* with a size, or ABS, LOG, CLIP, CAST."""

    kind: str
    column: str
    output: str
    size: int = 1
    low: float = 0.0
    high: float = 0.0
    dtype: str = ""
    ieee: bool = False

    def __post_init__(self):
        if self.size < 1:
            raise ValueError(f"{self.kind}: size must be positive")
        if self.kind == "CLIP" and self.low > self.high:
            raise ValueError("CLIP: lower bound exceeds upper")


@dataclass(frozen=True)
class Expr:
    expression: str
    output: str


def ts_ema(column: str, span: int, output: str) -> Factor:
    return Factor("TS_EMA", column, output, span)


def ts_mean(column: str, window: int, output: str) -> Factor:
    return Factor("TS_MEAN", column, output, window)


def ts_std(column: str, window: int, output: str) -> Factor:
    return Factor("TS_STD", column, output, window)


def ts_delay(column: str, period: int, output: str) -> Factor:
    return Factor("TS_DELAY", column, output, period)


def ts_diff(column: str, period: int, output: str) -> Factor:
    return Factor("TS_DIFF", column, output, period)


def ts_return(column: str, period: int, output: str) -> Factor:
    return Factor("TS_RETURN", column, output, period)


def absolute(column: str, output: str) -> Factor:
    return Factor("ABS", column, output)


def log(column: str, output: str, ieee: bool = False) -> Factor:
    """Values that aren't positive fail; with ``ieee`` zero gives -Infinity and negative ones NaN."""
    return Factor("LOG", column, output, ieee=ieee)


def clip(column: str, low: float, high: float, output: str) -> Factor:
    return Factor("CLIP", column, output, low=low, high=high)


def cast(column: str, dtype: str, output: str) -> Factor:
    return Factor("CAST", column, output, dtype=dtype)


@dataclass(frozen=True)
class Agg:
    """A window aggregate; ``build`` takes the order key of the rows."""

    kind: str
    column: str
    output: str
    weight: str = ""

    def build(self, order: Column) -> Column:
        x = F.col(f"`{self.column}`")
        if self.kind == "VWAP":
            w = F.col(f"`{self.weight}`")
            return F.sum(x * w) / F.sum(w)  # a total weight of zero is an error
        return {
            "FIRST": lambda: F.min_by(x, order), "LAST": lambda: F.max_by(x, order), "SUM": lambda: F.sum(x), "MAX": lambda: F.max(x),
            "MIN": lambda: F.min(x), "COUNT": lambda: F.count(F.lit(1)),
        }[self.kind]().cast("double")


def agg_first(column: str, output: str) -> Agg:
    return Agg("FIRST", column, output)


def agg_last(column: str, output: str) -> Agg:
    return Agg("LAST", column, output)


def agg_sum(column: str, output: str) -> Agg:
    return Agg("SUM", column, output)


def agg_max(column: str, output: str) -> Agg:
    return Agg("MAX", column, output)


def agg_min(column: str, output: str) -> Agg:
    return Agg("MIN", column, output)


def agg_count(column: str, output: str) -> Agg:
    return Agg("COUNT", column, output)


def agg_vwap(price: str, volume: str, output: str) -> Agg:
    return Agg("VWAP", price, output, volume)


@dataclass(frozen=True)
class Cross:
    kind: str
    column: str
    output: str
    nulls_last: bool = False


def cs_rank(column: str, output: str, nulls_last: bool = False) -> Cross:
    """Invalid values have no rank; with ``nulls_last`` they are one tie after all others."""
    return Cross("RANK", column, output, nulls_last)


def cs_zscore(column: str, output: str) -> Cross:
    return Cross("ZSCORE", column, output)


def cs_demean(column: str, output: str) -> Cross:
    return Cross("DEMEAN", column, output)
