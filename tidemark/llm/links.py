"""Connected components of an edge table by star contraction, with union-find inside partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, discard, made, met, width

HELD = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the edges that isn't its component's least."""
    x, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    top = np.arange(len(x))
    while True:
        p, q = top[i], top[j]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(top, p, least)
        np.minimum.at(top, q, least)
        while not np.array_equal(up := top[top], top):
            top = up
    low = top != np.arange(len(x))
    return x[low], x[top[low]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition, ``HELD`` at a time, become stars around the least node: one row a node."""
    held: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        u, v = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)])
        n += b.num_rows
        if n >= HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b", stars_already: bool = False) -> DataFrame:
    """(node, component): the least node id reachable from each node that an edge names.

    A round points the greater neighbours of every node at its least neighbour (large star), then brings
    the rows of each greater end together and contracts what a partition holds (small star). Before that
    exchange every partition has contracted its own edges, so it sends one row a node: nobody's rows are
    hot there. Rounds grow with the logarithm of the longest path; only counts reach the driver. ``stars_already`` says
    that the edges come from tasks that have contracted theirs.
    """
    spark = edges.sparkSession
    n = width(spark)

    def stars(df: DataFrame, contracted: bool = False) -> DataFrame:
        own = df if contracted else df.mapInArrow(_contracted, "u long, v long")
        return own.repartition(n, "u").mapInArrow(_contracted, "u long, v long")

    before, watch = made(), Observation()
    e = cut(stars(edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")), stars_already), watch, F.count("*").alias("n"))
    size = watch.get["n"]
    while size:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        # a centre with a lesser neighbour, or a node with two of them: without such the edges are stars already
        loose = F.when((F.col("v") > F.col("u")) & (F.col("m") < F.col("u")) | (F.col("v") < F.col("u")) & (F.col("v") != F.col("m")), 1)
        watch = Observation()
        large = met(both, least, "u", "d", 2 * size).observe(watch, F.count(loose).alias("moved")).where("v > u")
        old, count = [p for p in made() if p not in before], Observation()
        e = cut(stars(large.select(F.col("v").alias("u"), F.col("m").alias("v"))), count, F.count("*").alias("n"))
        discard(spark, old)
        size = count.get["n"]
        if not watch.get["moved"]:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
