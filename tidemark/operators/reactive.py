"""Per-instrument factors in arrival order.

All factors of one call share one exchange by instrument: it satisfies every window below it, whose partition is the
instrument and the validity of the input. Mean, deviation, delay, difference and return are window expressions;
those of one input share its window, so its sort too. The exponential average is recursive: its rows are sorted by
instrument in the same partitioning and streamed through Arrow batches with one number of state per instrument, so no
instrument's rows are ever held together. What comes out of that stream has no partitioning that Spark knows of, so
rolling factors that follow an exponential average take another exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import expression as X
from tidemark.functions import values as V
from tidemark.functions.factors import Expr, Factor
from tidemark.schema import need, need_id, need_new
from tidemark.session import ship


def filter_ids(df: DataFrame, id_column: str, ids: Iterable[str] | None, observation: Observation | None = None) -> DataFrame:
    """Rows of the listed instruments; an empty list is an error. An observation gets the rows left out."""
    if ids is None:
        return df
    ids = list(ids)
    if not ids:
        raise ValueError("the id filter is empty")
    if observation is not None:
        df = df.observe(observation, F.count(F.when(~F.coalesce(F.col(id_column).isin(ids), F.lit(False)), 1)).alias("filtered_rows"))
    return df.where(F.col(id_column).isin(ids))


def _ema(span: int):
    alpha = 2.0 / (span + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            n = b.num_columns
            names, x = b.column(n - 2), b.column(n - 1).to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(x):
                continue
            opens = np.ones(len(x), bool)
            opens[1:] = pc.not_equal(names.slice(1), names.slice(0, len(x) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            run_of = np.cumsum(opens)
            carried = names[0].as_py() == now and state is not None
            values = pd.Series(np.append(state, x) if carried else x)
            groups = np.append(run_of[0], run_of) if carried else run_of
            out = values.groupby(groups).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[len(values) - len(x) :]
            state = None if np.isnan(out[-1]) else out[-1]  # rows without a value repeat the state
            now = names[len(x) - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(out, pa.float64(), mask=np.isnan(x))], [*b.schema.names[: n - 2], "_ema"])

    return run


def ema_column(df: DataFrame, id_column: str, x: Column, span: int, order: Sequence[str], output: str, dealt: bool = False) -> DataFrame:
    """``df`` and the exponential average of ``x`` (null where ``x`` is, state untouched). ``dealt`` says that an
    instrument's rows are in one partition already."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])
    rows = df.withColumns({"_id": F.col(f"`{id_column}`"), "_x": x})
    rows = rows if dealt else rows.repartition(f"`{id_column}`")
    return rows.sortWithinPartitions("_id", *order).mapInArrow(_ema(span), schema)


def _rolling(kind: str, x: Column, ok: Column, n: int, id_column: str, order: Sequence[str]) -> Column:
    """Frames count valid rows only: validity is part of the partition."""
    own = Window.partitionBy(id_column, ok).orderBy(*order)
    frame = own.rowsBetween(-(n - 1), 0)
    if kind in ("TS_MEAN", "TS_STD"):
        value = F.when(F.count(x).over(frame) >= n, (F.avg(x) if kind == "TS_MEAN" else F.stddev_pop(x)).over(frame))
    else:
        before = F.lag(x, n).over(own)
        if kind == "TS_DELAY":
            value = before
        elif kind == "TS_DIFF":
            value = x - before
        else:
            ratio = F.try_divide(x, before) - 1.0
            value = F.when(~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio)
    return F.when(ok, value)


def reactive(
    df: DataFrame, id_column: str, factors: Sequence[Factor | Expr], order_by: Sequence[str],
    id_filter: Iterable[str] | None = None, invalid: str = "reject", observation: Observation | None = None,
) -> DataFrame:
    """All columns of ``df`` and one per factor, in order; a factor may use an earlier one's output.

    ``order_by`` gives the arrival order and must end in a unique column. ``invalid`` says what null,
    NaN, infinite and sentinel inputs do: ``reject`` fails the query, ``skip`` gives null and leaves the
    factor's history as it is. In expressions a null input always skips.
    """
    if invalid not in ("reject", "skip"):
        raise ValueError("invalid must be reject or skip")
    need_id(df, id_column)
    need_new([f.output for f in factors], df.columns)
    columns = list(df.columns)
    df = filter_ids(df, id_column, id_filter, observation)
    made, dealt, inputs = 0, False, {}

    def stage(kind: str, x: Column, n: int, name: str, output: str, nulls_fail: bool, source: object) -> None:
        """``source`` tells inputs apart: one that several factors have is checked and windowed once."""
        nonlocal df, dealt, made
        given = V.checked(x, name, nulls_fail) if invalid == "reject" else x
        if kind == "TS_EMA":
            df = ema_column(df, id_column, F.when(V.finite(given), given), n, order_by, output, dealt)
            dealt = False
            return
        if not dealt:
            df, dealt = df.repartition(F.col(f"`{id_column}`")), True
        if source not in inputs:
            made += 1
            inputs[source] = f"_in{made}"
            df = df.withColumn(f"_in{made}", given).withColumn(f"_ok{made}", V.finite(F.col(f"_in{made}")))
        own = inputs[source]
        df = df.withColumn(output, _rolling(kind, F.col(own), F.col(own.replace("_in", "_ok")), n, id_column, order_by))

    for f in factors:
        if isinstance(f, Expr):
            done: dict[X.Node, str] = {}

            def staged(kind: str, x: Column, n: int, node: X.Node) -> Column:
                nonlocal made
                if node not in done:
                    made += 1
                    done[node] = f"_stage{made}"
                    stage(kind, x, n, kind, done[node], False, node.args[0])
                return F.col(done[node])

            value, _ = X.build(X.parse(f.expression), T.StructType([s for s in df.schema if s.name in columns]), staged)
            df = df.withColumn(f.output, value)
        else:
            need(df, f.column, "double", role="value column")
            x = F.col(f"`{f.column}`")
            if f.kind.startswith("TS_"):
                stage(f.kind, x, f.size, f.column, f.output, True, ("column", f.column))
            else:
                x = V.checked(x, f.column) if invalid == "reject" else F.when(V.finite(x), x)
                df = df.withColumn(f.output, {
                    "ABS": lambda x=x: F.abs(x), "LOG": lambda x=x, f=f: V.natural_log(x, ieee=f.ieee), "CAST": lambda x=x, f=f: V.convert(x, "double", f.dtype),
                    "CLIP": lambda x=x, f=f: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(f.high))), F.lit(float(f.low)))),
                }[f.kind]())
        columns.append(f.output)
    return df.select(*[F.col(f"`{c}`") for c in columns])
