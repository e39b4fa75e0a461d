"""Immutable, lazy tables: each method gives a new table over one more step of the same DataFrame plan.

Storage order is explicit: head, tail and slice follow ``order_by``, the columns that define it, or the last
``sort``, and fail without either. The order stays when its columns are dropped, renamed or replaced: a table
carries copies of them, which no result shows and Catalyst prunes where nothing needs them. Nulls sort last in both
directions. Steps run in the order in which they are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.expr import Expression, col, wrap

Order = tuple[tuple[str, bool], ...]  # hidden column and whether it descends


def _sorting(order: Order, back: bool = False) -> list[Column]:
    out = []
    for name, down in order:
        c = F.col(f"`{name}`")
        out.append((c.asc_nulls_first() if down else c.desc_nulls_first()) if back else (c.desc_nulls_last() if down else c.asc_nulls_last()))
    return out


class Table:
    """``fresh`` resolves a stored table anew; each terminal call then sees what has been appended meanwhile."""

    def __init__(self, df: DataFrame, order_by: Sequence[str] = (), fresh: Callable[[], DataFrame] | None = None):
        self._steps: tuple[Callable[[Table], Table], ...] = ()
        self._source, self._fresh, self._order_by = df, fresh, tuple(order_by)
        self._names = list(df.columns)
        self._order: Order = tuple((f"_order{i}", False) for i in range(len(self._order_by)))
        self._sorted = False
        self._rows = df.withColumns({f"_order{i}": F.col(f"`{c}`") for i, c in enumerate(self._order_by)})

    def _next(self, rows: DataFrame, names: Sequence[str] | None = None, order: Order | None = None, is_sorted: bool | None = None) -> Table:
        out = object.__new__(Table)
        out.__dict__.update(self.__dict__)
        out._rows = rows
        out._names = list(self._names if names is None else names)
        out._order = self._order if order is None else order
        out._sorted = self._sorted if is_sorted is None else is_sorted
        return out

    def _then(self, step: Callable[[Table], Table]) -> Table:
        """One more step, which is also remembered for tables that resolve anew."""
        out = step(self)
        out._steps = (*self._steps, step)
        return out

    def _hidden(self) -> list[Column]:
        return [F.col(f"`{c}`") for c, _ in self._order]

    def _visible(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in self._names])

    @property
    def columns(self) -> list[str]:
        return list(self._names)

    @property
    def df(self) -> DataFrame:
        """The rows as they are now; in order where ``sort`` has asked for one."""
        t = self._now()
        return t._visible(t._in_order() if t._sorted else t._rows)

    def _now(self) -> Table:
        if self._fresh is None:
            return self
        t = Table(self._fresh(), self._order_by)
        for step in self._steps:
            t = step(t)
        return t

    def _column(self, e: Any, name: str = "") -> Column:
        c = (col(e) if isinstance(e, str) else wrap(e)).to_column(self._rows.schema)
        return c.alias(name) if name else c

    def _need(self, names: Sequence[str]) -> None:
        missing = [n for n in names if n not in self._names]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")

    def filter(self, predicate: Expression | None = None, **equals: Any) -> Table:
        def step(t: Table) -> Table:
            rows = t._rows if predicate is None else t._rows.where(predicate.to_column(t._rows.schema))
            for name, value in equals.items():
                rows = rows.where((col(name) == value).to_column(t._rows.schema))
            return t._next(rows)

        return self._then(step)

    where = filter

    def between(self, column: str, start: Any, end: Any) -> Table:
        return self.filter(col(column).is_between(start, end))

    def select(self, *columns: str | Expression, **named: Any) -> Table:
        def step(t: Table) -> Table:
            rows = t._rows.select(*[t._column(c) for c in columns], *[t._column(e, n) for n, e in named.items()], *t._hidden())
            return t._next(rows, rows.columns[: len(rows.columns) - len(t._order)])

        return self._then(step)

    def with_columns(self, *exprs: Expression, **named: Any) -> Table:
        """All expressions see the columns as they were."""

        def step(t: Table) -> Table:
            new = {e.name: t._column(e) for e in exprs} | {n: t._column(e) for n, e in named.items()}
            return t._next(t._rows.withColumns(new), [*t._names, *[n for n in new if n not in t._names]])

        return self._then(step)

    def join(self, other: Table | DataFrame, *, on: str | Sequence[str], how: str = "inner", suffix: str = "_right") -> Table:
        """Equi-join in the left side's order; null keys meet nothing; the right side's columns of the same name get a suffix."""
        on = [on] if isinstance(on, str) else list(on)
        if how not in ("inner", "left", "right", "full", "semi", "anti"):
            raise ValueError(f"unknown join [{how}]")

        def step(t: Table) -> Table:
            right = other.df if isinstance(other, Table) else other
            right = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in t._names and c not in on})
            rows = t._rows.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
            return t._next(rows, [c for c in rows.columns if c not in dict(t._order)])

        return self._then(step)

    def sort(self, by: str | Sequence[str], *, descending: bool | Sequence[bool] = False) -> Table:
        by = [by] if isinstance(by, str) else list(by)
        self._need(by)
        down = [descending] * len(by) if isinstance(descending, bool) else list(descending)
        if len(down) != len(by):
            raise ValueError("one direction for each key")

        def step(t: Table) -> Table:
            new = {f"_order{len(t._order) + i}": F.col(f"`{c}`") for i, c in enumerate(by)}
            # equal keys keep the order they had
            return t._next(t._rows.withColumns(new), order=(*zip(new, down, strict=True), *t._order), is_sorted=True)

        return self._then(step)

    def _in_order(self) -> DataFrame:
        return self._rows.orderBy(*_sorting(self._order)) if self._order else self._rows

    def _need_order(self, what: str) -> None:
        if not self._order:
            raise ValueError(f"{what} needs an order: give order_by or sort first")

    def head(self, n: int) -> Table:
        if n < 0:
            raise ValueError("n must not be negative")
        self._need_order("head")
        return self._then(lambda t: t._next(t._in_order().limit(n)))

    limit = head

    def tail(self, n: int) -> Table:
        """The last n rows: the first n of the reversed order, a bounded top-n."""
        if n < 0:
            raise ValueError("n must not be negative")
        self._need_order("tail")
        return self._then(lambda t: t._next(t._rows.orderBy(*_sorting(t._order, back=True)).limit(n)))

    def slice(self, offset: int, length: int | None = None) -> Table:
        """``length`` rows from ``offset``; a negative offset counts from the end."""
        if length is not None and length < 0:
            raise ValueError("length must not be negative")
        self._need_order("slice")
        if offset < 0:
            last = self.tail(-offset)
            return last if length is None else last.head(length)

        def step(t: Table) -> Table:
            rows = t._in_order().offset(offset)
            return t._next(rows if length is None else rows.limit(length))

        return self._then(step)

    def drop(self, *columns: str) -> Table:
        self._need(columns)
        return self._then(lambda t: t._next(t._rows.drop(*columns), [c for c in t._names if c not in columns]))

    def rename(self, mapping: Mapping[str, str] | None = None, **renames: str) -> Table:
        names = dict(mapping or {}) | renames
        self._need(list(names))
        return self._then(lambda t: t._next(t._rows.withColumnsRenamed(names), [names.get(c, c) for c in t._names]))

    def snapshot(self) -> Table:
        """The same rows for every later terminal call, whatever is appended meanwhile: the list of files is
        fixed when a DataFrame is made, and this one is not made again."""
        t = self._now()
        return t._next(t._rows)

    def _ordered(self) -> DataFrame:
        t = self._now()
        return t._visible(t._in_order())

    def collect(self) -> list:
        return self._ordered().collect()

    def stream(self) -> Iterator:
        return self._ordered().toLocalIterator()

    def to_pyarrow(self):
        return self._ordered().toArrow()

    def to_reader(self, rows: int = 65_536):
        """A record-batch reader that fetches a partition at a time."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        df = self._ordered()
        schema = to_arrow_schema(df.schema)

        def batches():
            held: list = []
            for r in df.toLocalIterator():
                held.append(r.asDict())
                if len(held) == rows:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

        return pa.RecordBatchReader.from_batches(schema, batches())

    def to_pandas(self):
        return self._ordered().toPandas()

    def to_polars(self):
        import polars  # an optional library

        return polars.from_arrow(self.to_pyarrow())

    def explain(self, mode: str = "formatted") -> str:
        """Logical, optimised and physical plan as text, with the sort where one was asked for."""
        df = self.df
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def profile(self) -> tuple[list, dict]:
        """Rows, and what reading them took: rows out, rows of the scanned table (not of those joined), files, seconds."""
        began, t = time.perf_counter(), self._now()
        rows = t._visible(t._in_order()).collect()
        took = time.perf_counter() - began
        source = self._source if self._fresh is None else self._fresh()
        return rows, {"rows": len(rows), "scanned_rows": source.count(), "files": len(t._rows.inputFiles()), "seconds": took}


def read_table(spark: SparkSession, path: str, order_by: Sequence[str] = (), snapshot: bool = True) -> Table:
    """A stored table; without ``snapshot`` each terminal call looks at what is stored then."""
    from tidemark.sources.tables import read

    return Table(read(spark, path), order_by, None if snapshot else lambda: read(spark, path))
