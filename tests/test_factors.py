import pytest
from pyspark.sql import functions as F

from tidemark.functions import factors as K
from tidemark.functions.expression import parse
from tidemark.operators.reactive import reactive
from tidemark.schema import SchemaMismatch


def table(spark, values, ids=None):
    return spark.createDataFrame([(i, (ids or ["a"] * len(values))[i], v) for i, v in enumerate(values)], "seq long, id string, value double")


def run(df, *factors, **how):
    return [tuple(r)[3:] for r in reactive(df, "id", list(factors), ["seq"], **how).orderBy("seq").collect()]


@pytest.mark.parametrize(("factor", "want"), [
    (K.ts_mean("value", 3, "y"), [None, None, 15.0, 20.0]), (K.ts_std("value", 3, "y"), [None, None, 3.7416573867739413, 3.7416573867739413]), (K.ts_delay("value", 2, "y"), [None, None, 10.0, 16.0]),
    (K.ts_diff("value", 2, "y"), [None, None, 9.0, 9.0]), (K.ts_return("value", 1, "y"), [None, 0.6, 0.1875, 25 / 19 - 1]), (K.clip("value", 12.0, 20.0, "y"), [12.0, 16.0, 19.0, 20.0]),
    (K.cast("value", "int64", "y"), [10, 16, 19, 25]), (K.cast("value", "utf8", "y"), ["10", "16", "19", "25"]), (K.ts_ema("value", 3, "y"), [10.0, 13.0, 16.0, 20.5]),
])
def test_goldens(spark, factor, want):
    got = [r[0] for r in run(table(spark, [10.0, 16.0, 19.0, 25.0]), factor)]
    assert got == [pytest.approx(w, abs=1e-12) if isinstance(w, float) else w for w in want]


def test_state_is_kept_by_instrument(spark):
    got = run(table(spark, [1.0, 10.0, 2.0, 20.0], ["a", "b", "a", "b"]), K.ts_diff("value", 1, "d"), K.ts_ema("value", 1, "e"))
    assert got == [(None, 1.0), (None, 10.0), (1.0, 2.0), (10.0, 20.0)]


def test_skip_leaves_history_alone(spark):
    values = [10.0, None, 16.0, float("nan"), 19.0, 1e300, 25.0]
    got = run(table(spark, values), K.ts_mean("value", 3, "m"), K.ts_ema("value", 3, "e"), invalid="skip")
    assert got == [(None, 10.0), (None, None), (None, 13.0), (None, None), (15.0, 16.0), (None, None), (20.0, 20.5)]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), 1e300])
def test_reject_fails(spark, bad):
    with pytest.raises(Exception, match="invalid value"):
        run(table(spark, [1.0, bad]), K.ts_mean("value", 1, "m"))


def test_expressions_skip_nulls_even_under_reject(spark):
    assert [r[0] for r in run(table(spark, [1.0, None, 3.0]), K.Expr("TS_DIFF(value, 1)", "d"))] == [None, None, 2.0]
    with pytest.raises(Exception, match="invalid value"):
        run(table(spark, [1.0, float("inf")]), K.Expr("TS_DIFF(value, 1)", "d"))


@pytest.mark.parametrize(("text", "want"), [
    ("value / (value - 2)", [None, 3.0]), ("-value * 2 + 1", [-3.0, -5.0]), ("ABS(-value)", [2.0, 3.0]), ("CAST(value * 1.9, 'int32')", [3, 5]), ("CAST(value, 'string')", ["2", "3"]),
    ("TS_MEAN(TS_DIFF(value, 1), 1) + TS_DIFF(value, 1)", [None, 2.0]), ("CLIP(value, 2.5, 9)", [2.5, 3.0]), ("CAST('7', 'int64')", [7, 7]), ("CAST(value * 9000000000, 'int32')", [2147483647] * 2),
])
def test_expressions(spark, text, want):
    assert [r[0] for r in run(table(spark, [2.0, 3.0]), K.Expr(text, "y"))] == want


@pytest.mark.parametrize("text", ["", "a +", "abs(value)", "Log(value)", "(value", "value value", "1e5", "TS_MEAN(value, 0)", "TS_MEAN(value, 1.5)", "CLIP(value)", "CAST(value, 'date')", "nothing + 1", "value > 1", "'a' + 1"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        run(table(spark, [1.0]), K.Expr(text, "y"))


@pytest.mark.parametrize("text", ["LOG(value)", "CLIP(value, 3, 2)", "CAST('x', 'int64')"])
def test_failing_rows(spark, text):
    with pytest.raises(Exception, match="positive|exceeds|CAST_INVALID"):
        run(table(spark, [-1.0]), K.Expr(text, "y"))


def test_log_of_zero(spark):
    """As IEEE and the query's SQL have it, where that is asked for; else a failure."""
    got = [r[0] for r in run(table(spark, [0.0, -0.0, 1.0]), K.log("value", "y", ieee=True))]
    assert got == [float("-inf"), float("-inf"), 0.0]
    assert str(run(table(spark, [-1.0]), K.log("value", "y", ieee=True))[0][0]) == "nan"
    with pytest.raises(Exception, match="positive"):
        run(table(spark, [0.0]), K.log("value", "y"))


def test_equal_calls_are_computed_once(spark):
    out = reactive(table(spark, [1.0]), "id", [K.Expr("TS_DELAY(value, 1) * TS_DELAY(value, 1)", "y")], ["seq"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lag(") == 1
    assert parse("1 + 2 * 3").op == "+" and parse("(1 + 2) * 3").op == "*"


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_one_exchange_by_instrument(spark):
    df = table(spark, [float(i) for i in range(50)], ["a", "b"] * 25)
    four = [K.ts_mean("value", 3, "m"), K.ts_std("value", 3, "s"), K.ts_delay("value", 1, "d"), K.ts_return("value", 1, "r")]
    assert exchanges(reactive(df, "id", four, ["seq"])) == 1
    assert exchanges(reactive(df, "id", [K.Expr("TS_STD(TS_RETURN(value, 1), 4) * 100", "x"), K.Expr("TS_MEAN(value, 2) - TS_DIFF(value, 1)", "y"), K.ts_mean("x", 2, "z")], ["seq"], invalid="skip")) == 1
    assert exchanges(reactive(df, "id", [*four, K.ts_ema("value", 3, "e")], ["seq"])) == 1


def test_ema_over_batches(spark):
    """Batches of three rows: instruments begin, end and go on anywhere; nulls at the ends keep the state."""
    values = [1.0, None, 3.0, 4.0, None, None, None, 8.0, 9.0, 2.0, None, 5.0, None, 7.0, 7.5]
    ids = ["a"] * 8 + ["b"] * 2 + ["c"] * 1 + ["d"] * 4
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [r[0] for r in run(table(spark, values, ids), K.ts_ema("value", 3, "e"), invalid="skip")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, state = [], {}
    for i, x in zip(ids, values):
        if x is not None:
            state[i] = x if i not in state else 0.5 * x + 0.5 * state[i]
        want.append(None if x is None else pytest.approx(state[i], abs=1e-12))
    assert got == want


def test_checks(spark):
    df = table(spark, [1.0])
    for bad in (lambda: reactive(df.withColumn("id", F.lit(1)), "id", [], ["seq"]), lambda: reactive(df.withColumn("value", F.lit(1)), "id", [K.ts_mean("value", 1, "m")], ["seq"]), lambda: reactive(df, "id", [K.ts_mean("value", 1, "value")], ["seq"]), lambda: reactive(df, "id", [K.ts_mean("none", 1, "m")], ["seq"])):
        with pytest.raises(SchemaMismatch):
            bad()
    for bad in (lambda: reactive(df, "id", [], ["seq"], id_filter=[]), lambda: K.ts_mean("value", 0, "m"), lambda: K.clip("value", 2, 1, "c"), lambda: reactive(df, "id", [], ["seq"], invalid="no")):
        with pytest.raises(ValueError):
            bad()
