import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import factors as K
from tidemark.operators import bars as B
from tidemark.operators.compare import compare, digest
from tidemark.operators.cross_section import cross_section
from tidemark.operators.latest import changelog, latest, shard
from tidemark.operators.timeseries import timeseries

T0 = dt.datetime(2024, 1, 2)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, rows):
    return spark.createDataFrame([(i, a, at(s), float(v), float(w)) for i, (a, s, v, w) in enumerate(rows)], "seq long, id string, dt timestamp_ntz, value double, weight double")


def test_windows_and_factors_around_them(spark):
    df = series(spark, [("a", 1, 10, 2), ("a", 61, 12, 1), ("b", 59, 5, 3)])
    out = timeseries(df, "id", "dt", "1 minute", [K.agg_first("value", "f"), K.agg_last("value", "l"), K.agg_sum("amount", "s"), K.agg_count("value", "n"), K.agg_vwap("value", "weight", "p")], ["seq"], pre=[K.Expr("value * weight", "amount")], post=[K.Expr("s / n", "mean")])
    got = [tuple(r) for r in out.orderBy("id", "window_start").collect()]
    assert got == [("a", at(0), at(60), 10.0, 10.0, 20.0, 1.0, 10.0, 20.0), ("a", at(60), at(120), 12.0, 12.0, 12.0, 1.0, 12.0, 12.0), ("b", at(0), at(60), 5.0, 5.0, 15.0, 1.0, 5.0, 15.0)]


def test_late_rows(spark):
    df = series(spark, [("a", 100, 1, 1), ("a", 50, 2, 1), ("a", 100, 3, 1), ("b", 10, 4, 1), ("a", 99, 5, 1)])
    out = timeseries(df, "id", "dt", "1 minute", [K.agg_sum("value", "s")], ["seq"], late="drop")
    assert sorted((r.id, r.s) for r in out.collect()) == [("a", 4.0), ("b", 4.0)]
    with pytest.raises(Exception, match="late row"):
        timeseries(df, "id", "dt", "1 minute", [K.agg_sum("value", "s")], ["seq"]).collect()
    kept = timeseries(df, "id", "dt", "1 minute", [K.agg_count("value", "n")], ["seq"], late="drop", id_filter=["b"])
    assert [(r.id, r.n) for r in kept.collect()] == [("b", 1.0)]


def test_zero_weight_fails(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        timeseries(series(spark, [("a", 0, 1, 0)]), "id", "dt", "1 minute", [K.agg_vwap("value", "weight", "p")], ["seq"]).collect()
    with pytest.raises(ValueError):
        timeseries(series(spark, [("a", 0, 1, 0)]), "id", "dt", "1 minute", [K.agg_sum("value", "s")], ["seq"], post=[K.Expr("TS_MEAN(s, 2)", "m")])


def cross(spark, values, *factors):
    df = spark.createDataFrame([(i, s, at(t), v) for i, (s, t, v) in enumerate(values)], "seq long, symbol string, dt timestamp_ntz, ret double")
    return [tuple(r)[2:] for r in cross_section(df, "symbol", "dt", "1 minute", list(factors), ["seq"]).orderBy("dt", "symbol").collect()]


def test_cross_sections(spark):
    assert cross(spark, [("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 2.0)], K.cs_rank("ret", "r")) == [(1.0,), (2.5,), (2.5,)]
    assert cross(spark, [("a", 0, 5.0), ("b", 1, 5.0), ("c", 2, 5.0)], K.cs_zscore("ret", "z")) == [(0.0,)] * 3
    assert cross(spark, [("a", 0, 1.0), ("b", 1, None), ("c", 2, 3.0)], K.cs_zscore("ret", "z"), K.cs_demean("ret", "d"), K.cs_rank("ret", "r")) == [(-1.0, -1.0, 1.0), (None, None, None), (1.0, 1.0, 2.0)]
    assert cross(spark, [("a", 0, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), ("a", 200, 9.0)], K.cs_rank("ret", "r")) == [(2.0,), (1.0,), (1.0,)]
    with pytest.raises(ValueError):
        cross(spark, [("a", 0, 1.0)])


NAMES = B.InputColumns("id", "dt", "price", "v", "t", "day")


def bars(spark, ticks, volume=B.Volume(), auction="drop", label="start_dt"):
    df = spark.createDataFrame([(i, "x", dt.datetime(2024, 1, 2, *clock), float(p), None if v is None else float(v), float(t), "d1") for i, (clock, p, v, t) in enumerate(ticks)], "seq long, id string, dt timestamp_ntz, price double, v double, t double, day string")
    sessions = B.TradingSessions("UTC", [("09:00", "10:00")], [("08:55", "09:00")])
    return [(r.dt.hour, r.dt.minute, r.open, r.high, r.low, r.close, r.volume, r.total_turnover) for r in B.bars(df, B.Profile(NAMES, sessions, volume, auction, label), ["seq"]).orderBy("dt").collect()]


def test_cumulative_bars_skip_the_first_total(spark):
    ticks = [((9, 0, 1), 10, 100, 1000), ((9, 0, 30), 11, 105, 1050), ((9, 0, 59), 11, 107, 1060)]
    assert bars(spark, ticks[:2] + ticks[1:1], B.Volume("cumulative")) == [(9, 0, 11.0, 11.0, 11.0, 11.0, 5, 50.0)]
    assert bars(spark, ticks, B.Volume("cumulative", "from_zero")) == [(9, 0, 10.0, 11.0, 10.0, 11.0, 107, 1060.0)]
    falling = [*ticks, ((9, 1, 5), 12, 90, 1070), ((9, 1, 6), 13, 95, 1080)]
    assert bars(spark, falling, B.Volume("cumulative"))[1:] == [(9, 1, 13.0, 13.0, 13.0, 13.0, 5, 10.0)]


def test_first_delta_belongs_to_the_minute_before(spark):
    assert bars(spark, [((9, 0, 59), 10, 100, 10), ((9, 1, 1), 11, 105, 20), ((9, 1, 2), 12, 106, 30)], B.Volume("cumulative")) == [(9, 0, 11.0, 11.0, 11.0, 11.0, 5, 10.0), (9, 1, 12.0, 12.0, 12.0, 12.0, 1, 10.0)]


def test_auctions(spark):
    ticks = [((8, 59, 1), 9, 4, 36), ((9, 0, 1), 10, 4, 40), ((9, 0, 2), 8, 2, 12), ((10, 0, 0), 1, 1, 1), ((9, 0, 5), 7, None, 3)]
    assert bars(spark, ticks) == [(9, 0, 10.0, 10.0, 8.0, 8.0, 6, 52.0)]
    assert bars(spark, ticks, auction="merge_to_first_regular_bar") == [(9, 0, 9.0, 10.0, 8.0, 8.0, 10, 88.0)]
    assert bars(spark, ticks, auction="emit_separate_bar") == [(8, 55, 9.0, 9.0, 9.0, 9.0, 4, 36.0), (9, 0, 10.0, 10.0, 8.0, 8.0, 6, 52.0)]
    late = [((8, 59, 1), 9, 4, 36), ((9, 5, 0), 10, 1, 10)]
    assert bars(spark, late, auction="merge_to_first_regular_bar") == [(9, 5, 9.0, 10.0, 9.0, 10.0, 5, 46.0)]
    assert bars(spark, late[:1], auction="merge_to_first_regular_bar") == []


def test_bar_checks(spark):
    with pytest.raises(Exception, match="whole number"):
        bars(spark, [((9, 0, 1), 10, 1.5, 1)])
    for bad in ({"auction": "x"}, {"dt_label": "x"}, {"frequency": "5m"}, {"volume": B.Volume("x")}, {"sessions": B.TradingSessions("Mars", [("09:00", "10:00")])}):
        with pytest.raises(ValueError):
            B.Profile(**{"columns": NAMES, "sessions": B.TradingSessions("UTC", [("09:00", "10:00")])} | bad)


def test_sessions_over_midnight_and_local_time(spark):
    df = spark.createDataFrame([(0, "x", "2024-01-02 15:30:00", 1.0, 1.0, 1.0), (1, "x", "2024-01-02 16:30:00", 2.0, 1.0, 1.0), (2, "x", "2024-01-02 20:00:00", 3.0, 1.0, 1.0)], "seq long, id string, at string, price double, v double, t double").withColumn("dt", F.col("at").cast("timestamp"))
    out = B.bars(df, B.Profile(B.InputColumns("id", "dt", "price", "v", "t"), B.TradingSessions("Asia/Shanghai", [("23:00", "02:00")])), ["seq"])
    assert sorted(r.open for r in out.collect()) == [1.0, 2.0]


def test_latest_and_changelog(spark):
    df = spark.createDataFrame([(0, "b", 1.0, 0), (1, "a", 2.0, 0), (2, "b", 3.0, 0), (3, "a", 4.0, 7)], "seq long, k string, v double, batch long")
    assert sorted((r.k, r.v) for r in latest(df, ["k"], ["seq"]).collect()) == [("a", 4.0), ("b", 3.0)]
    got = [(r.kv_seq, r.kv_op, r.kv_snapshot_version, r.k, r.v) for r in changelog(df, ["k"], "batch", ["seq"]).orderBy("kv_seq").collect()]
    assert got == [(1, "upsert", 1, "a", 2.0), (2, "upsert", 1, "b", 3.0), (3, "upsert", 2, "a", 4.0)]
    with pytest.raises(Exception, match="null key"):
        latest(df.withColumn("k", F.when(F.col("seq") > 0, F.col("k"))), ["k"], ["seq"]).collect()


def test_latest_rows_of_fixed_width_are_not_sorted(spark):
    """Whole rows, also with equal, null and NaN orders and null values; a column of text still works."""
    table = [("b", 1.0, 1, 5.0), ("a", 2.0, None, None), ("b", None, 3, float("nan")), ("a", 4.0, 2, None), ("c", None, None, None), ("d", 1.0, 7, 1.0), ("d", 2.0, 7, 2.0), ("d", 3.0, 6, 9.0)]
    df = spark.createDataFrame(table, "k string, v double, n long, w double").repartition(3)
    out = latest(df, ["k"], ["n"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {r.k: tuple(r) for r in out.collect()}
    assert repr(got["b"]) == "('b', None, 3, nan)" and got["a"] == ("a", 4.0, 2, None) and got["c"] == ("c", None, None, None)
    assert got["d"] in [("d", 1.0, 7, 1.0), ("d", 2.0, 7, 2.0)] and len(got) == 4
    assert {r.k: r.v for r in latest(df, ["k"], ["w"]).collect()}["b"] is None
    assert {r.k: r.t for r in latest(df.withColumn("t", F.concat("k", F.lit("!"))), ["k"], ["n"]).collect()} == {k: f"{k}!" for k in "abcd"}


def test_shards(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 50).cast("double").alias("k"))
    out = shard(df, ["k"], 8)
    assert out.count() == 1000 and out.select("k", "shard").distinct().count() == 50 and out.where("shard < 0 or shard > 7").isEmpty()
    zero = spark.createDataFrame([(0.0,), (-0.0,)], "k double")
    assert shard(zero, ["k"], 97).select("shard").distinct().count() == 1
    with pytest.raises(Exception, match="shard key"):
        shard(spark.createDataFrame([(None,)], "k double"), ["k"], 4).collect()


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "i long, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (3, None)], "i long, s string")
    assert tuple(compare(a, b).first()) == (True, False, 3, 3, 1, 1, 1)
    assert compare(a, a.orderBy("s")).first().data_equal and not compare(a, a.withColumnRenamed("s", "t")).first().schema_equal
    assert digest(a).first() == digest(a.orderBy(F.desc("i"))).first() != digest(b).first()
