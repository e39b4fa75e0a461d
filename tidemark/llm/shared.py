"""Storage that every executor of the cluster sees, and small helpers on table columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: A key is heavy with over this share of the rows; so at most 1 / HEAVY_SHARE keys are, however many rows there are.
HEAVY_SHARE = 1 / 1000

_made: list[str] = []


def cut(df: DataFrame, observed: Observation | None = None, *metrics) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there.

    Metrics are taken of the rows as they are written. The folder is there until ``discard``."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df if observed is None else df.observe(observed, *metrics)).write.parquet(path)
    _made.append(path)
    return spark.read.schema(schema).parquet(path)


def made() -> list[str]:
    """The folders that ``cut`` has made and ``discard`` has not deleted."""
    return list(_made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``cut`` that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove(path)


def met(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` and the columns of ``facts`` (one row a key) but ``weight``, the number of rows of its key.

    Rows of heavy keys stay where they are and get theirs from a broadcast, whose rows the share bounds;
    the others meet theirs by key.
    """
    own = [c for c in facts.columns if c not in (key, weight)]
    packed = facts.select(key, F.struct(*own).alias("_facts"), (F.col(weight) > total * HEAVY_SHARE).alias("_heavy"))
    marked = rows.join(F.broadcast(packed.where("_heavy").drop("_heavy")), key, "left")
    light = marked.where("_facts is null").drop("_facts").join(packed.where("not _heavy").drop("_heavy"), key, how)
    return marked.where("_facts is not null").unionByName(light).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_facts.`{c}`").alias(c) for c in own])


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle; the one knob that sizes cells and buckets to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_of(df: DataFrame):
    """A row's columns as one, so that names of its columns can't meet names of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def fields_of(df: DataFrame, row: str = "row") -> list:
    return [F.col(f"{row}.`{c}`").alias(c) for c in df.columns]
