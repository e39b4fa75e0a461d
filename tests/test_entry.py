import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["pw_abs_log_clip_cast", "factor_pipeline"])
def test_zero_prices_equal_the_sql(spark, tmp_path, name):
    """Zeros first, last and alone in an hour, and alone in a day."""
    c = duckdb.connect()
    c.execute(f"CREATE TABLE events AS SELECT * REPLACE (CASE WHEN user_id % 3 = 0 AND (event_id % 2 = 0 OR user_id % 2 = 0) THEN 0.0 ELSE value END AS value) FROM '{SF}/events.parquet'")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows and len(rows) > 300


@pytest.mark.parametrize("name", ["pw_abs_log_clip_cast", "ts_delay", "bars_delta", "bars_cumulative_skip", "bars_missing_data"])
def test_halves_equal_the_sql(spark, tmp_path, name):
    """Prices halfway between two numbers of six or of four places, and some whose logarithm is rounded to minus zero."""
    c = duckdb.connect()
    halves = "CASE WHEN event_id % 50 = 0 THEN 1 - event_id / 1e10 WHEN event_id % 2 = 0 THEN value + 0.00005 ELSE value + (event_id * 10 + 5) / 1e7 END"
    c.execute(f"CREATE TABLE events AS SELECT * REPLACE ({halves} AS value) FROM '{SF}/events.parquet'")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows and len(rows) > 30


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_optional_part(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    importlib.invalidate_caches()


def test_an_error_inside_the_optional_part_is_not_hidden(tmp_path):
    root = Path(entry.__file__).parent
    if not (root / "tidemark" / "llm").exists():
        pytest.skip("the optional part isn't there")
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    (tmp_path / "tidemark" / "llm" / "words.py").write_text("import nothing_of_this_name\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode and "nothing_of_this_name" in out.stderr
