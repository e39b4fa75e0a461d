import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import factors as K
from tidemark.operators.timeseries import timeseries
from tidemark.plans.expr import col, lit, time_range
from tidemark.plans.table import Table, read_table
from tidemark.schema import SchemaMismatch
from tidemark.operators import bars as B
from tidemark.operators.cross_section import cross_section
from tidemark.sources import tables as S
from tidemark.sources.catalog import Catalog
from tidemark.sources.plugin import read_source
from tidemark.sources.shards import ShardedTable
from tidemark.streaming import streams
from tidemark.streaming.factors import accepted, bar_stream, cross_sections, rolling


@pytest.fixture
def table(spark):
    return Table(spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (3, "a", 1.0), (4, None, 2.0)], "seq long, k string, v double"), ["seq"])


def seqs(t):
    return [r.seq for r in t.collect()]


def test_steps_run_in_their_order(table):
    assert seqs(table.head(2).filter(col("v") > 0)) == [1]
    assert seqs(table.filter(col("v") > 0).head(2)) == [1, 3]
    assert seqs(table.tail(2)) == [3, 4] and seqs(table.slice(1, 2)) == [2, 3] and seqs(table.slice(-3, 2)) == [2, 3] and seqs(table.slice(2)) == [3, 4]
    assert seqs(table.sort("v")) == [3, 4, 1, 2] and seqs(table.sort("v", descending=True)) == [1, 4, 3, 2] and seqs(table.sort("v").tail(2)) == [1, 2]
    assert seqs(table.sort(["k", "v"], descending=[True, False]).head(3)) == [2, 3, 1]
    assert [r.v for r in table.with_columns(v=col("v") * 2, w=col("v") + 1).select("seq", "v", "w").collect()][0] == 6.0


def test_expressions(table):
    assert seqs(table.filter(col("k").is_null() | (col("k") == "b"))) == [2, 4] and seqs(table.filter(~col("k").is_in(["a"]))) == [2]
    assert seqs(table.where(k="a").between("v", 1, 2)) == [3]
    values = table.select(q=lit(1) / (col("v") - 1), m=-col("v"), r=2 - col("v")).df.collect()
    assert values[2].q == float("inf") and values[0].q == 0.5 and values[1].q is None and values[0].m == -3.0 and values[0].r == -1.0
    with pytest.raises(TypeError):
        bool(col("a") == 1)


def test_columns_that_are_not_there(table):
    for bad in (lambda: table.drop("x"), lambda: table.rename({"x": "y"}), lambda: table.sort("x"), lambda: table.head(-1), lambda: table.slice(0, -1), lambda: Table(table.df).head(1), lambda: Table(table.df).slice(0, 1), lambda: Table(table.df).tail(1), lambda: table.join(table, on="seq", how="cross")):
        with pytest.raises(ValueError):
            bad()
    assert table.rename(k="key").drop("v").df.columns == ["seq", "key"] and seqs(table.rename(v="w").tail(1)) == [4]


def test_order_outlives_its_columns(table):
    assert [r.seq for r in table.sort("v").select("seq").collect()] == [3, 4, 1, 2] and [r.k for r in table.sort("v").drop("v", "seq").collect()] == ["a", None, "a", "b"]
    assert [r.v for r in table.select("v").tail(2).collect()] == [1.0, 2.0] and [r.k for r in table.sort("seq", descending=True).with_columns(seq=lit(0)).select("k").head(2).collect()] == [None, "a"]
    assert [r.k for r in table.sort("v").rename(v="w").with_columns(v=lit(1)).select("k").collect()] == ["a", None, "a", "b"]
    ordered = table.sort("v").select("seq")
    assert ordered.df.columns == ["seq"] and [r.seq for r in ordered.df.collect()] == [3, 4, 1, 2] and "Sort [" in ordered.explain("simple")
    assert [r.seq for r in table.sort("k", descending=True).sort("v").select("seq").join(table.select("seq", "v"), on="seq").collect()] == [3, 4, 1, 2]


def test_snapshot_and_fresh_reads(spark, tmp_path):
    S.append(rows(spark, 5), path := str(tmp_path / "t"))
    pinned, live = read_table(spark, path, ["seq"]), read_table(spark, path, ["seq"], snapshot=False).filter(col("v") > 0).select("seq")
    held = live.snapshot()
    S.append(rows(spark, 8).where("seq >= 5"), path)
    assert len(pinned.collect()) == 5 and seqs(held) == [1, 2, 3, 4] and seqs(live) == list(range(1, 8)) and seqs(live.tail(2)) == [6, 7]
    assert live.to_reader(3).read_all()["seq"].to_pylist() == list(range(1, 8)) and live.profile()[1]["scanned_rows"] == 8 and live.df.count() == 7


def test_join_suffix_and_nulls(table):
    out = table.join(table.select("k", "v"), on="k", how="left", suffix="_2")
    assert out.df.columns == ["k", "seq", "v", "v_2"] and out.df.count() == 6 and table.join(table, on="k", how="anti").df.count() == 1


@pytest.mark.parametrize(("text", "start", "end"), [
    ("2024-12", (2024, 12, 1), (2025, 1, 1)), ("2024-02-29", (2024, 2, 29), (2024, 3, 1)), ("2024-01-01 10:59", (2024, 1, 1, 10, 59), (2024, 1, 1, 11)), ("2024-01-01T10:00:59", (2024, 1, 1, 10, 0, 59), (2024, 1, 1, 10, 1)),
    ("2024-01-01 00:00:00.25", (2024, 1, 1, 0, 0, 0, 250000), (2024, 1, 1, 0, 0, 0, 260000)), (dt.date(2024, 1, 1), (2024, 1, 1), (2024, 1, 2)),
])
def test_time_literals(text, start, end):
    assert time_range(text) == (dt.datetime(*start), dt.datetime(*end))


def test_time_zones_in_literals(spark):
    df = spark.createDataFrame([("2024-01-01 00:30:00",), ("2024-01-01 08:30:00",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert Table(df).filter(col("t") < "2024-01-01 08:30+08:00").df.count() == 0
    assert Table(df).filter(col("t") == "2024-01-01 08:30+08:00").df.count() == 1
    assert time_range("hello") is None and time_range(7) is None


def test_explain_profile_and_pushdown(spark):
    t = read_table(spark, "/root/testdata/sf0.001/orders.parquet").filter(col("o_totalprice") > 1000).select("o_orderkey")
    plan = t.explain()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    rows, facts = t.profile()
    assert len(rows) == facts["rows"] and facts["files"] == 1 and t.to_pyarrow().num_rows == len(rows) == len(list(t.stream())) == len(t.to_pandas())


def rows(spark, n=100):
    return spark.range(n).select(F.format_string("%06d", F.col("id") % 3).alias("id"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int))").alias("dt"), F.col("id").cast("double").alias("v"), F.col("id").alias("seq"))


def test_persist_compact_and_catalog(spark, tmp_path):
    path, c = str(tmp_path / "t"), Catalog(spark, str(tmp_path))
    for k in range(3):
        S.persist(rows(spark).where(F.col("seq") % 3 == k), path, "dt", "%Y%m%d", "id")
    back = S.read(spark, path)
    assert back.count() == 100 and {r.id for r in back.select("id").distinct().collect()} == {"000000", "000001", "000002"} and back.select("dt_part").distinct().count() == 5
    assert S.replayed_equal(back.select("id", "dt", "v", "seq"), rows(spark))
    S.append(rows(spark), str(tmp_path / "u"), row_capacity=10)
    S.append(rows(spark), str(tmp_path / "u"), row_capacity=10)
    before = c.table_info("u")
    assert c.list_tables() == ["t", "u"] and before["rows"] == 200 and before["files"] >= 20 and c.table_alerts("u", max_files=5) == ["too many files"]
    merged = c.compact_table("u", ["dt", "seq"])
    assert merged[0]["rows"] == 200 and merged[0]["least"] == dt.datetime(2024, 1, 1) and merged[0]["files_after"] < 5 and c.table_info("u")["rows"] == 200 and c.table_health("u", max_files=5)["healthy"] and not c.compact_table("u", ["dt"], min_files=9)
    assert len(c.compact_tables({"t": ["dt", "seq"]}, min_files=2)["t"]) == S.partitions(spark, path).count() - S.partitions(spark, path).where("files > 1").count() or c.table_info("t")["files"] == 15
    assert S.replayed_equal(S.read(spark, path).select("id", "dt", "v", "seq"), rows(spark)) and S.retain(spark, path, 2) == 3 and S.read(spark, path).select("dt_part").distinct().count() == 2
    assert c.drop_table("u") and not c.drop_table("u") and c.table_alerts("u") == ["missing"]
    with pytest.raises(ValueError):
        S.persist(rows(spark), path, dt_part="%Y")
    with pytest.raises(SchemaMismatch):
        S.append(spark.range(1).select(F.array("id").alias("a")), path)
    with pytest.raises(Exception, match="null partition"):
        S.persist(rows(spark).withColumn("id", F.lit(None).cast("string")), path, id_column="id")


def test_values_and_replay(spark, tmp_path):
    assert S.from_values(spark, {"a": [1, 2]}).count() == 2 and S.from_values(spark, {"a": 1}).count() == 1 and S.from_values(spark, [{"a": 1}, {"a": 2}]).count() == 2 and S.from_values(spark, pa.table({"a": [1]})).count() == 1
    rows(spark).write.parquet(p := str(tmp_path / "r"))
    assert S.replay(spark, p, "dt", dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 3)).count() == 3
    with pytest.raises(SchemaMismatch):
        S.replay(spark, p, schema=spark.range(1).toDF("nothing").schema)


def test_key_value_table(spark, tmp_path):
    t = S.KeyValueTable(spark, str(tmp_path / "kv"), ["id"], ["seq"])
    t.upsert(rows(spark, 5))
    t.upsert(rows(spark, 0))
    t.upsert(rows(spark, 8).where("seq > 6"))
    assert sorted((r.id, r.seq) for r in t.snapshot().collect()) == [("000000", 3), ("000001", 7), ("000002", 2)]
    assert [(r.kv_seq, r.kv_snapshot_version, r.id) for r in t.changes().orderBy("kv_seq").collect()] == [(1, 1, "000000"), (2, 1, "000001"), (3, 1, "000002"), (4, 2, "000001")]


def test_key_value_table_opened_again(spark, tmp_path):
    path, keyed = str(tmp_path / "kv"), lambda n: rows(spark, n).withColumn("key", F.format_string("%03d", "seq"))
    first = S.KeyValueTable(spark, path, ["key"], ["seq"])
    first.upsert(keyed(60), 0)
    (tmp_path / "kv" / "snapshot" / "2e1").mkdir()  # a version that was never finished
    keyed(9).select(F.lit(61).cast("long").alias("kv_seq"), F.lit("upsert").alias("kv_op"), F.lit(2).cast("long").alias("kv_snapshot_version"), "*").write.parquet(f"{path}/changelog/kv_part=2")
    again = S.KeyValueTable(spark, path, ["key"], ["seq"])
    assert (again.version, again.epoch, again.next_seq) == (1, 0, 61) and again.changes().count() == 60
    again.upsert(keyed(60), 0)
    assert again.version == 1
    again.upsert(keyed(70).where("seq >= 50"), 1)
    assert again.snapshot().count() == 70 and again.version == 2
    again.upsert(keyed(70).where("seq = 69"), 2)
    assert again.snapshot().count() == 70 and sorted(f.name for f in (tmp_path / "kv" / "snapshot").iterdir()) == ["2e1", "3e2"]
    assert [(r.kv_seq, r.seq) for r in again.changes().orderBy("kv_seq").collect()] == [*((k + 1, k) for k in range(60)), *((k + 11, k) for k in range(50, 70)), (81, 69)]


def test_streams(spark, tmp_path):
    data = rows(spark)
    for k in range(2):
        data.where(F.col("seq").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(src := str(tmp_path / "src"))
    stream = streams.source(spark, src, data.schema, 1)
    kv = S.KeyValueTable(spark, str(tmp_path / "kv"), ["id"], ["seq"])
    streams.upsert_stream(stream, kv, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.seq for r in kv.snapshot().collect()) == [97, 98, 99] and kv.version == 2
    got = []
    q = streams.subscribe_table(stream, lambda b: got.append([r.seq for r in b.collect()]), str(tmp_path / "c2"), F.col("id") == "000001", 2, ["seq"])
    q.awaitTermination()
    assert sorted(map(tuple, got)) == [(46, 49), (94, 97)] and not streams.live_health(q)["failed"]
    wins = streams.timeseries(stream, "id", "dt", "6 hours", [K.agg_sum("v", "s")], ["seq"], "0 seconds")
    streams.persist_stream(wins, out := str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    batch = {(r.id, r.window_start): r.s for r in timeseries(data, "id", "dt", "6 hours", [K.agg_sum("v", "s")], ["seq"]).collect()}
    closed = {(r.id, r.window_start): r.s for r in spark.read.parquet(out).collect()}
    assert len(closed) >= len(batch) - 3 and all(batch[k] == v for k, v in closed.items())
    ema = streams.stateful_ema(stream, "id", "v", 3, ["seq"], "e")
    streams.persist_stream(ema, out2 := str(tmp_path / "out2"), str(tmp_path / "c4")).awaitTermination()
    from tidemark.operators.reactive import reactive

    want = {r.seq: round(r.e, 9) for r in reactive(data, "id", [K.ts_ema("v", 3, "e")], ["seq"]).collect()}
    assert {r.seq: round(r.e, 9) for r in spark.read.parquet(out2).collect()} == want


def test_sharded_table(spark, tmp_path):
    t = ShardedTable(spark, str(tmp_path / "sharded"), ["id"], 4)
    t.write(rows(spark).where("seq < 60"))
    t.write(rows(spark).where("seq >= 60"))
    assert S.replayed_equal(t.df().select("id", "dt", "v", "seq"), rows(spark)) and [r.seq for r in t.table(["seq"]).filter(col("v") > 90).tail(3).select("seq").collect()] == [97, 98, 99]
    parts = [t.shard(i) for i in range(4)]
    assert sum(p.count() for p in parts) == 100 and sum(p.select("id").distinct().count() for p in parts) == 3
    with pytest.raises(ValueError, match="subscribed"):
        t.subscribe(print)
    for bad in (lambda: ShardedTable(spark, "x", [], 4), lambda: ShardedTable(spark, "x", ["id"], 0), lambda: t.write(rows(spark).withColumn("shard", F.lit(1)))):
        with pytest.raises(ValueError):
            bad()
    assert 1 <= ShardedTable(spark, "x", ["id"]).shards <= 16


@pytest.fixture
def stream(spark, tmp_path):
    """Ten files of ten rows, a file a micro-batch."""
    data = rows(spark)
    for k in range(10):
        data.where(F.col("seq").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(src := str(tmp_path / "src"))
    return data, streams.source(spark, src, data.schema, 1), tmp_path


def test_rolling_factors_on_a_stream(spark, stream):
    from tidemark.operators.reactive import reactive

    data, live, tmp = stream
    for i, f in enumerate((K.ts_mean("v", 3, "y"), K.ts_std("v", 4, "y"), K.ts_delay("v", 2, "y"), K.ts_diff("v", 5, "y"), K.ts_return("v", 1, "y"))):
        noisy = lambda df: df.withColumn("v", F.when(F.col("seq") % 7 != 3, F.col("v")))
        streams.persist_stream(rolling(noisy(live), "id", f, ["seq"]), out := str(tmp / f"o{i}"), str(tmp / f"c{i}")).awaitTermination()
        want = {r.seq: r.y if r.y is None else round(r.y, 9) for r in reactive(noisy(data), "id", [f], ["seq"], invalid="skip").collect()}
        assert {r.seq: r.y if r.y is None else round(r.y, 9) for r in spark.read.parquet(out).collect()} == want


def test_lateness_by_instrument_on_a_stream(spark, stream):
    from tidemark.operators.timeseries import accept

    data, live, tmp = stream
    late = lambda df: df.withColumn("dt", F.when(F.col("seq") % 9 == 4, F.col("dt") - F.expr("interval 30 hours")).otherwise(F.col("dt")))
    streams.persist_stream(accepted(late(live), "id", "dt", ["seq"]), out := str(tmp / "o"), str(tmp / "c")).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == sorted(r.seq for r in accept(late(data), "id", "dt", ["seq"], "drop").collect())


def test_cross_sections_and_bars_on_a_stream(spark, stream):
    data, live, tmp = stream
    got = []
    engine = cross_sections(str(tmp / "w"), "id", "dt", "6 hours", [K.cs_rank("v", "r"), K.cs_demean("v", "d")], ["seq"], lambda df, _: got.extend(df.collect()))
    engine.start(live, str(tmp / "c")).awaitTermination()
    before = len(got)
    engine.flush(spark)
    want = sorted(cross_section(data, "id", "dt", "6 hours", [K.cs_rank("v", "r"), K.cs_demean("v", "d")], ["seq"]).collect())
    assert 0 < before < len(got) and sorted(got) == want
    with pytest.raises(ValueError, match="late row"):
        engine.each(data.where("seq = 1"), engine.last + 1)
    names = B.InputColumns("id", "dt", "v", "seq", "seq")
    profile, out = B.Profile(names, B.TradingSessions("UTC", [("00:00", "23:59:59")]), auction="drop"), []
    made = bar_stream(str(tmp / "b"), profile, ["seq"], lambda df, _: out.extend(df.collect()))
    made.start(live, str(tmp / "c2")).awaitTermination()
    made.flush(spark)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, B.bars(data, profile, ["seq"]).collect()), key=str)
    with pytest.raises(ValueError):
        bar_stream("x", B.Profile(names, profile.sessions, auction="merge_to_first_regular_bar"), ["seq"], print)


def test_subscriptions(spark, stream):
    data, live, tmp = stream
    got, kv = [], S.KeyValueTable(spark, str(tmp / "kv"), ["id"], ["seq"])
    streams.subscribe_table(live, lambda b: got.append(sorted(r.seq for r in b.collect())), str(tmp / "c1"), F.col("id") == "000001", batch_size=10).awaitTermination()
    assert [len(g) for g in got] == [10, 10, 10] and sum(got, []) == list(range(1, 90, 3))
    snapshots, changes = [], []
    streams.latest_stream(live, kv, lambda df: snapshots.append(sorted(r.seq for r in df.collect())), str(tmp / "c2")).awaitTermination()
    assert len(snapshots) == 10 and snapshots[-1] == [97, 98, 99]
    other = S.KeyValueTable(spark, str(tmp / "kv2"), ["id"], ["seq"])
    streams.subscribe_key_value(live, other, str(tmp / "c3"), on_changes=lambda df: changes.append((df.columns, df.count()))).awaitTermination()
    assert changes == [(["id", "dt", "v", "seq"], 3)] * 10
    for bad in (lambda: streams.subscribe_key_value(live, other, "x", print, start_from=3), lambda: streams.subscribe_key_value(live, other, "x"), lambda: streams.subscribe(live, print, "x", start_from=0), lambda: streams.subscribe_table(live, print, "x", count=3)):
        with pytest.raises(ValueError):
            bad()


def test_replays_and_health(spark, stream):
    data, live, tmp = stream
    got = []
    r = streams.Replay(spark, str(tmp / "src"), data.schema, str(tmp / "c1"), lambda b: got.append(b.count()), time_column="dt", start=dt.datetime(2024, 1, 1, 10), end=dt.datetime(2024, 1, 2), files_per_batch=2)
    q = r.run()
    assert streams.wait_healthy(q, 60)["error"] is None
    q.awaitTermination()
    assert sum(got) == 15 and len(got) == 5 and not streams.needs_rebuild(q)
    with pytest.raises(RuntimeError):
        r.run()
    streams.Replay(spark, str(tmp / "src"), data.schema, str(tmp / "c2"), target=str(tmp / "out")).run().awaitTermination()
    assert S.replayed_equal(spark.read.parquet(str(tmp / "out")), data)
    for bad in ({}, {"callback": print, "target": "x"}, {"callback": print, "start": 1}):
        with pytest.raises(ValueError):
            streams.Replay(spark, str(tmp / "src"), data.schema, "x", **bad)
    failing = streams.subscribe_table(live, lambda b: 1 / 0, str(tmp / "c3"))
    with pytest.raises(Exception, match="division"):
        failing.awaitTermination()
    assert streams.needs_rebuild(failing) and streams.live_health(failing)["failed"]


def test_python_source(spark):
    def start(sink, part, parts):
        for k in range(part, 10, parts):
            sink.emit({"k": k, "name": f"n{k}"})
            yield
        sink.emit([{"k": 100 + part, "name": None}])

    got = read_source(spark, start, spark.createDataFrame([], "k long, name string").schema, 3)
    assert sorted((r.k, r.name) for r in got.collect()) == [*((k, f"n{k}") for k in range(10)), *((100 + p, None) for p in range(3))]
