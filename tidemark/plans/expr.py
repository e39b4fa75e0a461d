"""Query expressions: col, lit, and time literals that stand for ranges.

An expression is a small tree; ``to_column`` turns it into a Spark Column for a given schema. Comparing
a time column with text such as ``"2026-05"`` compares with the whole range that the text names.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERAL = re.compile(r"(\d{4})-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$")


def time_range(value: Any) -> tuple[dt.datetime, dt.datetime] | None:
    """Half-open range of a time literal; its length is what the literal leaves open. None if it isn't one."""
    if isinstance(value, dt.datetime):
        return value, value + dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        start = dt.datetime(value.year, value.month, value.day)
        return start, start + dt.timedelta(days=1)
    if not isinstance(value, str) or not (m := _LITERAL.match(value.strip())):
        return None
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    start = dt.datetime(int(year), int(month), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int(((fraction or "0") + "000000")[:6]))
    if zone:
        text = "+0000" if zone == "Z" else zone.replace(":", "")
        start = start.replace(tzinfo=dt.timezone((1 if text[0] == "+" else -1) * dt.timedelta(hours=int(text[1:3]), minutes=int(text[3:5]))))
    if day is None:
        end = start.replace(year=start.year + 1, month=1) if start.month == 12 else start.replace(month=start.month + 1)
    elif hour is None:
        end = start + dt.timedelta(days=1)
    elif second is None:
        end = start + dt.timedelta(minutes=1)
    elif fraction is None:
        end = start + dt.timedelta(seconds=1)
    else:
        end = start + dt.timedelta(microseconds=10 ** max(0, 6 - len(fraction)))
    return start, end


def _moment(value: dt.datetime, kind: str) -> Column:
    if kind == "timestamp_ntz":
        return F.lit(value.replace(tzinfo=None) if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit((value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).isoformat()).cast("timestamp")


class Expression:
    def __init__(self, build: Callable[[T.StructType], Column], name: str = "", time_of: str = ""):
        self._build, self.name, self._time_of = build, name, time_of

    def to_column(self, schema: T.StructType) -> Column:
        c = self._build(schema)
        return c.alias(self.name) if self.name and not self._time_of else c

    def alias(self, name: str) -> Expression:
        return Expression(self._build, name)

    def __bool__(self):
        raise TypeError("use & | ~ instead of and, or, not")

    def _kind(self, schema: T.StructType) -> str:
        if self._time_of in schema.names:
            return schema[self._time_of].dataType.simpleString()
        return ""

    def _compare(self, other: Any, op: str) -> Expression:
        def build(schema: T.StructType) -> Column:
            kind, own = self._kind(schema), self._build(schema)
            span = time_range(other) if kind.startswith("timestamp") and not isinstance(other, Expression) else None
            if span is None:
                value = wrap(other)._build(schema)
                return {"==": lambda: own == value, "!=": lambda: own != value, ">": lambda: own > value, ">=": lambda: own >= value, "<": lambda: own < value, "<=": lambda: own <= value}[op]()
            start, end = (_moment(v, kind) for v in span)
            return {"==": lambda: (own >= start) & (own < end), "!=": lambda: (own < start) | (own >= end), ">": lambda: own >= end, ">=": lambda: own >= start, "<": lambda: own < start, "<=": lambda: own < end}[op]()

        return Expression(build)

    def _with(self, other: Any, f: Callable[[Column, Column], Column], swap: bool = False) -> Expression:
        def build(schema: T.StructType) -> Column:
            a, b = self._build(schema), wrap(other)._build(schema)
            return f(b, a) if swap else f(a, b)

        return Expression(build)

    def __eq__(self, other):  # type: ignore[override]
        return self._compare(other, "==")

    def __ne__(self, other):  # type: ignore[override]
        return self._compare(other, "!=")

    def __gt__(self, other):
        return self._compare(other, ">")

    def __ge__(self, other):
        return self._compare(other, ">=")

    def __lt__(self, other):
        return self._compare(other, "<")

    def __le__(self, other):
        return self._compare(other, "<=")

    __hash__ = None  # type: ignore[assignment]

    def __and__(self, other):
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._with(other, lambda a, b: a | b)

    def __invert__(self):
        return Expression(lambda s: ~self._build(s))

    def __neg__(self):
        return Expression(lambda s: -self._build(s))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __radd__(self, other):
        return self._with(other, lambda a, b: a + b, True)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self._with(other, lambda a, b: a - b, True)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __rmul__(self, other):
        return self._with(other, lambda a, b: a * b, True)

    def __truediv__(self, other):
        return self._with(other, _divide)

    def __rtruediv__(self, other):
        return self._with(other, _divide, True)

    def is_in(self, values: Iterable[Any]) -> Expression:
        listed = list(values)
        return Expression(lambda s: self._build(s).isin(listed))

    def is_null(self) -> Expression:
        return Expression(lambda s: self._build(s).isNull())

    def is_not_null(self) -> Expression:
        return Expression(lambda s: self._build(s).isNotNull())

    def is_between(self, low: Any, high: Any) -> Expression:
        """Both ends included; with time literals the whole of both."""
        return (self >= low) & (self <= high)


def _divide(a: Column, b: Column) -> Column:
    """True division of floating numbers: x/0 is infinite, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(a)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def col(name: str) -> Expression:
    return Expression(lambda s: F.col(f"`{name}`"), name, name)


def lit(value: Any) -> Expression:
    return Expression(lambda s: F.lit(value))


def wrap(value: Any) -> Expression:
    return value if isinstance(value, Expression) else lit(value)
