"""Checks of input schemas and of output names, done when an operator is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    pass


def need(df: DataFrame, name: str, *kinds: str, role: str = "column") -> None:
    if name not in df.columns:
        raise SchemaMismatch(f"{role} [{name}] is missing")
    kind = df.schema[name].dataType.simpleString()
    if kinds and kind not in kinds:
        raise SchemaMismatch(f"{role} [{name}] must be {' or '.join(kinds)}, not {kind}")


def need_id(df: DataFrame, name: str) -> None:
    need(df, name, "string", role="id column")


def need_time(df: DataFrame, name: str) -> None:
    need(df, name, "timestamp", "timestamp_ntz", role="time column")


def need_new(names: Iterable[str], taken: Iterable[str]) -> None:
    seen = set(taken)
    for n in names:
        if n in seen:
            raise SchemaMismatch(f"output column [{n}] is there twice")
        seen.add(n)


def same(left: T.StructType, right: T.StructType) -> bool:
    """Names and types in order; nullability aside."""
    return [(f.name, f.dataType) for f in left] == [(f.name, f.dataType) for f in right]
