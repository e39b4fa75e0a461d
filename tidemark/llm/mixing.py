"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are put in a random but fixed order and dealt into blocks of ``block_docs``.
A source with ``a`` of ``L`` weight parts must get its i-th block in the slots
``[floor(i*L/a), ceil((i+1)*L/a))``: released at the first, due by the last. Earliest deadline first
meets all these windows (the parts sum to L, one block a slot), so at any slot every source has had
its share to less than one block. The schedule repeats after L slots; only one period is simulated,
on the driver, and block numbers are mapped to slots by arithmetic in Spark.

When a source has no block left a new phase begins, with the weights of the rest scaled up; within
each phase the bound holds. No row is dropped or repeated. Sources without a weight come last.

Row numbers within a source need no single task: rows are counted by source and by the leading bits
of their order key, running sums of these counts, in two levels, give each such bucket's first number, and only rows
of one bucket are ordered together.

Any number of sources has blocks of its own. Beyond ``PLANNED`` sources the driver holds no plan; then the ideal is
shares in exact proportion at any moment, scaled up the moment a source has no block left. A source of weight w has had
min(w*v, its blocks) when all have had T(v), the sum of these; so its i-th block is released at floor(T(i/w)) and due by
ceil(T((i+1)/w)). The ideal shares fill these windows, whole slots can then, and earliest deadline first does: again each
source has had its share to less than one block (and what doubles round). Blocks stream through one task in the order of
their release; it keeps those released and not placed, at most one a source.

With ``own_sources`` given, only so many sources of most weight have blocks of their own. All others share blocks, in random
order: those with a weight as one source of their summed weight, those without one as one that comes last; the
bound then holds for the others as a whole.

Edge cases: a null source is a source of its own (named null in ``source``); a null doc_id is ordered
like an id; rows that repeat a doc_id are ordered by their other columns; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, fields_of, row_of, width
from tidemark.session import ship

PARTS = 1000
BLOCK_DOCS = 32
#: without given weights a source weighs its size to this power: between the sources' sizes (1) and equal shares (0)
POWER = 0.7
ROWS_A_BUCKET = 4096
#: up to so many sources the driver plans phases
PLANNED = 256
#: blocks of a source that are made from one row
CHUNK = 4096


def parts_of(weights: Mapping[str, float], total: int = PARTS) -> dict[str, int]:
    """Whole weight parts that sum to ``total``, at least one each, by largest remainder."""
    some = {s: float(w) for s, w in weights.items() if w > 0}
    if not some:
        return {}
    total, scale = max(total, len(some)), sum(some.values())
    exact = {s: w / scale * (total - len(some)) for s, w in some.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period, earliest deadline first."""
    total = sum(parts.values())
    due = sorted((i * total // a, -(-(i + 1) * total // a), s) for s, a in parts.items() for i in range(a))
    out: dict[str, list[int]] = {s: [] for s in parts}
    ready: list[tuple[int, str]] = []
    k = 0
    for slot in range(total):
        while k < len(due) and due[k][0] <= slot:
            heapq.heappush(ready, due[k][1:])
            k += 1
        deadline, s = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline is missed")
        out[s].append(slot)
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], total: int = PARTS) -> list[tuple]:
    """(source, first block, end block, first slot, parts, period length, slots in the period) rows."""
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    slot, out = 0, []
    while left:
        active = {s: weights.get(s, 0.0) for s in left}
        if not any(w > 0 for w in active.values()):
            active = dict.fromkeys(left, 1.0)
        parts = parts_of(active, total)
        at, length = period(parts), sum(parts.values())
        end = min(((left[s] - 1) // a) * length + at[s][(left[s] - 1) % a] + 1 for s, a in parts.items())
        for s, a in parts.items():
            got = (end // length) * a + sum(x < end % length for x in at[s])
            out.append((s, done[s], done[s] + got, slot, a, length, at[s]))
            done[s] += got
            left[s] -= got
            if not left[s]:
                del left[s]
        slot += end
    return out


def _earliest_due(totals: Mapping[int, tuple[int, float]]):
    """Slots of blocks that come by release; ``totals`` has the first slot and the summed weight of each tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, slot, tier, ended, left, rest, n = [], 0, None, 0, 0.0, 0.0, 0
        for b in batches:
            out = []

            def place() -> None:
                nonlocal slot
                _, _, name, i = heapq.heappop(waiting)  # noqa: B023, used at once
                out.append((name, i, slot))  # noqa: B023
                slot += 1

            for t, at, due, name, i, blocks, w in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if t != tier:
                    while waiting:
                        place()
                    tier, ended, rest = t, 0, 0.0
                    begin, left = totals[t]
                    whole = left
                if i < 0:  # the source has had all its blocks; what is lost of the sum of the others' weights is kept in rest
                    ended, less = ended + blocks, left - w
                    back = less - left
                    rest += (left - (less - back)) - (w + back)
                    left = less
                    continue
                released = begin + math.floor(ended + at * (left + rest) - 1e-6 - 1e-12 * at * whole)
                while waiting and slot < released:
                    place()
                n += 1
                heapq.heappush(waiting, (due, n, name, i))
            yield _placed(out)
        out = []
        while waiting:
            _, _, name, i = heapq.heappop(waiting)
            out.append((name, i, slot))
            slot += 1
            if len(out) == 10_000:
                yield _placed(out)
                out = []
        yield _placed(out)

    return run


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    names, blocks, slots = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], ["_source", "_block", "_slot"])


def slots_of(weighed: DataFrame, block_docs: int) -> DataFrame:
    """``_source``, ``_block`` and ``_slot`` of all blocks of any number of sources (_name, n, w)."""
    ship(weighed.sparkSession)
    free = F.col("w") <= 0  # sources without a weight come last, with equal shares
    s = weighed.select("_name", F.ceil(F.col("n") / block_docs).alias("b"), F.when(free, F.lit(1.0)).otherwise(F.col("w")).alias("w"), F.when(free, 1).otherwise(0).alias("t"))
    begin, totals = 0, {}
    for r in s.groupBy("t").agg(F.sum("b").alias("b"), F.sum("w").alias("w")).orderBy("t").collect():
        totals[r["t"]], begin = (begin, r["w"]), begin + r["b"]
    chunks = s.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(b - 1) div {CHUNK}"))))
    each = chunks.withColumn("i", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("b"), (F.col("c") + 1) * CHUNK) - 1)))
    blocks = each.select("t", (F.col("i") / F.col("w")).alias("at"), ((F.col("i") + 1) / F.col("w")).alias("due"), "_name", "i", "b", "w")
    ends = s.select("t", (F.col("b") / F.col("w")).alias("at"), F.lit(None).cast("double").alias("due"), "_name", F.lit(-1).cast("long").alias("i"), "b", "w")
    events = blocks.unionByName(ends).coalesce(1).sortWithinPartitions("t", "at", F.col("due").asc_nulls_first(), "_name", "i")
    return events.mapInArrow(_earliest_due(totals), "_source string, _block long, _slot long")


def _scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS, seed: int = 7, own_sources: int | None = None, carried: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns of ``docs``, else all), ``_block``, ``_slot`` and ``_place`` (in the block)."""
    spark = docs.sparkSession
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    sized = docs.groupBy(named.alias("_name")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sized.withColumn("w", F.pow("n", F.lit(POWER)))
    else:
        given = spark.createDataFrame([(f"={s}" if s is not None else "null", float(w)) for s, w in weights.items()] or [("", 0.0)], "_name string, w double")
        weighed = sized.join(given, "_name", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    weighed = cut(weighed)
    many = own_sources is None and weighed.count() > PLANNED
    own = [] if many else weighed.orderBy(F.desc("w"), "_name").limit(PLANNED if own_sources is None else own_sources).collect()
    names = [r["_name"] for r in own]
    shared = [] if many else weighed.where(~F.col("_name").isin(names)).groupBy(F.when(F.col("w") > 0, "others").otherwise("others without weight").alias("_name")).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()
    sizes, rates = {r["_name"]: r["n"] for r in [*own, *shared]}, {r["_name"]: r["w"] for r in [*own, *shared]}
    light = weighed.where((F.col("w") == 0) & ~F.col("_name").isin(names)).select("_name", F.lit(True).alias("_light")) if len(shared) > 1 else None

    row = row_of(docs if carried is None else docs.select(*carried))
    rows = docs.select(row, F.col("doc_id").alias("_id"), named.alias("_name"), F.xxhash64(F.col("doc_id"), F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]).alias("_h"))
    of_others = F.lit(next((r["_name"] for r in shared), ""))
    if light is not None:
        rows, of_others = rows.join(light, "_name", "left"), F.when(F.col("_light"), "others without weight").otherwise("others")
    rows = rows.withColumn("_source", F.col("_name") if many else F.when(F.col("_name").isin(names), F.col("_name")).otherwise(of_others))

    total = weighed.agg(F.sum("n")).first()[0] if many else sum(sizes.values())
    bits = max(1, min(40, math.ceil(math.log2(max(1, total / ROWS_A_BUCKET)))) + 3)
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits))
    counted = cut(rows.groupBy("_source", "_bucket").agg(F.count("*").alias("n")).withColumn("_top", F.shiftright("_bucket", bits // 2)))

    def before(*by: str, order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = counted.groupBy("_source", "_top").agg(F.sum("n").alias("n")).select("_source", "_top", before("_source", order="_top").alias("_above"))
    first = counted.select("_source", "_top", "_bucket", before("_source", "_top", order="_bucket").alias("_within")).join(tops, ["_source", "_top"]).select("_source", "_bucket", (F.col("_above") + F.col("_within")).alias("_first"))
    mine = Window.partitionBy("_source", "_bucket").orderBy("_h", "_id")
    ranked = rows.withColumn("_rn", F.row_number().over(mine)).join(first, ["_source", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_rn") - 1)
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block_docs)).withColumn("_place", F.col("_rank") % block_docs)
    if many:
        return ranked.join(cut(slots_of(weighed, block_docs)), ["_source", "_block"]).select("row", "_block", "_slot", "_place")
    plan = phases({s: -(-n // block_docs) for s, n in sizes.items()}, rates)
    table = spark.createDataFrame(plan, "_source string, _from long, _to long, _slot0 long, _parts long, _length long, _at array<int>")
    # the plan has as many phases and rows a phase as sources at most (PLANNED, or own_sources + 2), PARTS numbers a phase
    met = ranked.alias("r").join(F.broadcast(table).alias("p"), (F.col("r._source") == F.col("p._source")) & (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to")))
    k = F.col("_block") - F.col("_from")
    slot = F.col("_slot0") + F.floor(k / F.col("_parts")) * F.col("_length") + F.element_at("_at", (k % F.col("_parts") + 1).cast("int"))
    return met.withColumn("_slot", slot.cast("long")).select("row", "_block", "_slot", "_place")


def scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, **how) -> DataFrame:
    """doc_id, source, block, slot and place (in the block) of every row."""
    out = _scheduled(docs, weights, carried=["doc_id", "source"], **how)
    return out.select("row.doc_id", "row.source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, **how) -> DataFrame:
    """The rows of ``docs`` in mixed order: partitions, and rows in each, follow the schedule."""
    return placed(docs, weights, **how).select(*[f"`{c}`" for c in docs.columns])


def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, **how) -> DataFrame:
    """``mixed``, with ``slot`` and ``place``, by which the order can be had again from stored rows."""
    out = _scheduled(docs, weights, **how)
    ordered = out.repartitionByRange(width(docs.sparkSession), "_slot", "_place").sortWithinPartitions("_slot", "_place")
    return ordered.select(*fields_of(docs), F.col("_slot").alias("slot"), F.col("_place").alias("place"))
