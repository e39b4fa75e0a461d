"""Session-aware one-minute bars from ticks, as window expressions and one aggregate.

Ticks are in arrival order (``order_by``); one exchange by instrument serves all windows. An older
minute that arrives late joins its bar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import fail
from tidemark.schema import need, need_id, need_time

MINUTE = 60
#: Offsets of the zones that bars know, in seconds.
ZONES = {"UTC": 0, "Etc/UTC": 0, "Asia/Shanghai": 8 * 3600}


@dataclass(frozen=True)
class InputColumns:
    instrument: str
    dt: str
    price: str
    volume: str
    total_turnover: str
    trading_day: str | None = None
    num_trades: str | None = None
    limit_up: str | None = None
    limit_down: str | None = None


@dataclass(frozen=True)
class TradingSessions:
    """Times of day as HH:MM or HH:MM:SS; an end at or before its start lies on the next day."""

    timezone: str
    regular: Sequence[tuple[str, str]]
    auction: Sequence[tuple[str, str]] = ()


@dataclass(frozen=True)
class Volume:
    """``delta``: ticks hold increments. ``cumulative``: totals of the trading day."""

    mode: str = "delta"
    bootstrap: str = "skip_first_delta"
    output_dtype: str = "int64"


@dataclass(frozen=True)
class Profile:
    columns: InputColumns
    sessions: TradingSessions
    volume: Volume = Volume()
    auction: str = "drop"
    dt_label: str = "close_dt"
    frequency: str = "1m"

    def __post_init__(self):
        for name, value, allowed in (
            ("frequency", self.frequency, ("1m",)), ("timezone", self.sessions.timezone, tuple(ZONES)), ("volume mode", self.volume.mode, ("delta", "cumulative")),
            ("bootstrap", self.volume.bootstrap, ("skip_first_delta", "from_zero")), ("output dtype", self.volume.output_dtype, ("int64", "float64")),
            ("auction", self.auction, ("drop", "merge_to_first_regular_bar", "emit_separate_bar")), ("dt label", self.dt_label, ("close_dt", "start_dt")),
        ):
            if value not in allowed:
                raise ValueError(f"{name} [{value}] is not one of {', '.join(allowed)}")
        if not self.sessions.regular:
            raise ValueError("at least one regular session is needed")
        if self.volume.mode == "cumulative" and not self.columns.trading_day:
            raise ValueError("cumulative volume needs a trading day column")


def seconds(clock: str) -> int:
    parts = [int(x) for x in clock.split(":")]
    if len(parts) not in (2, 3) or not (0 <= parts[0] < 24 and all(0 <= p < 60 for p in parts[1:])):
        raise ValueError(f"bad time of day [{clock}]")
    return parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) == 3 else 0)


def _within(second: Column, start: int, end: int) -> Column:
    return (second >= start) & (second < end) if start < end else (second >= start) | (second < end)


def bars(df: DataFrame, profile: Profile, order_by: Sequence[str]) -> DataFrame:
    """instrument, dt, open, high, low, close, volume, total_turnover, num_trades, limit_up, limit_down,
    start_dt and end_dt (first and last tick) and close_dt (end of the window)."""
    c, offset = profile.columns, ZONES[profile.sessions.timezone]
    need_id(df, c.instrument)
    need_time(df, c.dt)
    for name in (c.price, c.volume, c.total_turnover):
        need(df, name, "double", "bigint", role="market data")
    kind = df.schema[c.dt].dataType.simpleString()
    ntz = kind == "timestamp_ntz"

    def number(name: str) -> Column:
        return F.col(f"`{name}`").cast("double")

    def optional(name: str | None, as_kind: str) -> Column:
        return F.col(f"`{name}`").cast(as_kind) if name else F.lit(None).cast(as_kind)

    def moment(second: Column) -> Column:
        at = F.timestamp_seconds(second)
        return F.to_timestamp_ntz(F.date_format(at, "yyyy-MM-dd HH:mm:ss")) if ntz else at

    epoch = F.floor(F.unix_micros(F.col(c.dt).cast("timestamp")) / 1_000_000) if not ntz else F.expr(f"floor(timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', `{c.dt}`) / 1000000)")
    t = df.select(
        F.col(c.instrument).alias("id"), F.col(c.dt).alias("at"), epoch.cast("long").alias("sec"), number(c.price).alias("price"), number(c.volume).alias("v"), number(c.total_turnover).alias("t"),
        optional(c.trading_day, "string").alias("day"), optional(c.num_trades, "bigint").alias("trades"), optional(c.limit_up, "double").alias("up"), optional(c.limit_down, "double").alias("down"),
        F.struct(*[F.col(f"`{o}`") for o in order_by]).alias("seq"),
    )
    for name in ("price", "v", "t"):
        t = t.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    local = F.pmod(F.col("sec") + offset, F.lit(86400))
    regular = F.lit(False)
    for a, b in profile.sessions.regular:
        regular = regular | _within(local, seconds(a), seconds(b))
    midnight = F.col("sec") - local
    bounds = F.lit(None).cast("struct<a:bigint,b:bigint>")
    for a, b in reversed(list(profile.sessions.auction)):
        s, e = seconds(a), seconds(b)
        start = midnight + s if s < e else F.when(local >= s, midnight + s).otherwise(midnight + s - 86400)
        length = e - s if s < e else e - s + 86400
        bounds = F.when(_within(local, s, e), F.struct(start.cast("long").alias("a"), (start + length).cast("long").alias("b"))).otherwise(bounds)
    t = t.withColumns({"regular": regular, "auction": bounds}).where(F.col("regular") | F.col("auction").isNotNull())
    t = t.withColumn("win", F.floor(F.col("sec") / MINUTE).cast("long") * MINUTE)
    own = Window.partitionBy("id").orderBy("seq")

    if profile.volume.mode == "cumulative":
        t = t.where(F.col("day").isNotNull())
        t = t.withColumn("opens", F.coalesce(F.lag("day").over(own) != F.col("day"), F.lit(True)))
        t = t.withColumn("run", F.sum(F.col("opens").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        first = {x: (F.col(x) if profile.volume.bootstrap == "from_zero" else F.lit(None).cast("double")) for x in ("v", "t")}
        t = t.withColumns({f"d{x}": F.when(F.col("opens"), first[x]).otherwise(F.col(x) - F.lag(x).over(own)) for x in ("v", "t")})
        t = t.withColumn("good", F.coalesce((F.col("dv") >= 0) & (F.col("dt") >= 0), F.lit(False)))
        in_run = Window.partitionBy("id", "run").orderBy("seq")
        had = F.coalesce(F.sum(F.col("good").cast("int")).over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        t = t.withColumn("win", F.when((had == 0) & F.lag("regular").over(in_run), F.lag("win").over(in_run)).otherwise(F.col("win")))
        t = t.where("good").withColumns({"v": F.col("dv"), "t": F.col("dt")})
    end = F.col("win") + MINUTE
    if profile.auction == "drop":
        t = t.where("regular").withColumn("to", end)
    elif profile.auction == "emit_separate_bar":
        t = t.withColumns({"win": F.when(F.col("regular"), F.col("win")).otherwise(F.col("auction.a")), "to": F.when(F.col("regular"), end).otherwise(F.col("auction.b"))})
    else:
        earlier = F.coalesce(F.sum(F.col("regular").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        t = t.withColumn("grp", earlier)
        grp = Window.partitionBy("id", "grp").orderBy("seq")
        whole = grp.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        t = t.withColumns({"next": F.max(F.when(F.col("regular"), F.col("win"))).over(whole), "closes": F.first(F.when(~F.col("regular"), F.col("auction.b")), ignorenulls=True).over(whole)})
        day_of = lambda x: F.floor((x + offset) / 86400)
        joins = (F.col("closes") <= F.col("next") + MINUTE) & (day_of(F.col("closes")) == day_of(F.col("next")))
        t = t.where(F.col("regular") | F.coalesce(joins, F.lit(False))).withColumn("win", F.when(F.col("regular"), F.col("win")).otherwise(F.col("next"))).withColumn("to", F.col("win") + MINUTE)

    def last_some(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    g = t.groupBy("id", "win", "to").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("v").alias("v"), F.sum("t").alias("t"),
        F.sum("trades").alias("trades"), last_some("up").alias("up"), last_some("down").alias("down"), F.min_by("at", "seq").alias("first"), F.max_by("at", "seq").alias("last"),
    )
    volume = F.col("v")
    if profile.volume.output_dtype == "int64":
        volume = F.when(F.col("v") != F.floor("v"), fail("volume is not a whole number", "bigint")).otherwise(F.col("v").cast("bigint"))
    label = F.col("to") if profile.dt_label == "close_dt" else F.col("win")
    return g.select(
        F.col("id").alias(c.instrument), moment(label).alias("dt"), "open", "high", "low", "close", volume.alias("volume"), F.col("t").alias("total_turnover"), F.col("trades").alias("num_trades"),
        F.col("up").alias("limit_up"), F.col("down").alias("limit_down"), F.col("first").alias("start_dt"), moment(F.col("to")).alias("close_dt"), F.col("last").alias("end_dt"),
    )
