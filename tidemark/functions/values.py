"""Rules for valid numbers and for changing types, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: exchanges mark missing prices by numbers of this size and more
SENTINEL = 1e300
_INT = {"int64": ("bigint", -(2**63), 2**63 - 1), "int32": ("int", -(2**31), 2**31 - 1)}
CASTS = {"float64": "double", "float32": "float", "int64": "bigint", "int32": "int", "utf8": "string", "string": "string"}


def finite(x: Column) -> Column:
    """True for numbers that count: not null, NaN, infinite or a sentinel."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < SENTINEL)


def fail(message: str, kind: str = "double") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def checked(x: Column, name: str, nulls_fail: bool = True) -> Column:
    """``x``, or an error for the row if it isn't valid (null included or not)."""
    bad = ~finite(x) if nulls_fail else x.isNotNull() & ~finite(x)
    return F.when(bad, fail(f"invalid value in [{name}]")).otherwise(x)


def natural_log(x: Column, name: str = "LOG", ieee: bool = False) -> Column:
    if ieee:
        return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))
    return F.when(x <= 0, fail(f"{name}: value must be positive")).otherwise(F.ln(x))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null if any part is null; greatest and least alone would skip nulls."""
    some = x.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(some & (low > high), fail("CLIP: lower bound exceeds upper")).when(some, F.greatest(F.least(x, high), low))


def convert(x: Column, source: str, dtype: str) -> Column:
    """Cast by name; numbers to integers truncate and saturate, whole doubles print without a fraction."""
    if dtype not in CASTS:
        raise ValueError(f"unknown dtype [{dtype}]")
    if dtype in _INT and source in ("double", "float"):
        kind, low, high = _INT[dtype]
        d = x.cast("double")
        return F.when(F.isnan(d), F.lit(0).cast(kind)).when(d >= float(high), F.lit(high).cast(kind)).when(d <= float(low), F.lit(low).cast(kind)).otherwise(F.when(F.isnan(d) | (d >= float(high)) | (d <= float(low)), F.lit(0.0)).otherwise(d).cast(kind))
    if dtype == "int32" and source == "bigint":
        return F.greatest(F.least(x, F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")
    if CASTS[dtype] == "string" and source in ("double", "float"):
        whole = (F.abs(x) < 1e15) & (x == F.floor(x))
        return F.when(whole, F.floor(F.when(whole, x)).cast("bigint").cast("string")).otherwise(x.cast("string"))
    return x.cast(CASTS[dtype])
