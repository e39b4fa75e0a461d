"""Quality rules with risk-controlled thresholds.

Hand-written measures of a text get cutoffs from labelled holdouts. The cutoffs of all rules tighten together, step
by step; in every stratum (the ``lang`` of the row) the steps are tested from the loosest to the tightest. A step
holds if the exact binomial (Clopper-Pearson) bound shows that at most ``risk`` of the good texts that pass the
base rules break any rule there. The level of a stratum's test is ``delta / strata`` (Bonferroni); testing in a fixed
order that stops at the first failure needs no further correction, and as the union of all rules is what is
tested, nor do the rules. So the rules reject at most ``risk`` of each stratum's good texts, in all strata
together with probability ``1 - delta``. Of the steps that hold the loosest that catches most bad texts is taken. A
stratum with too few labels to show this (some 220 good texts for four strata) rejects nothing beyond the base rules.

The bounds are for independent texts: equal texts of a stratum count once, as good if all their labels say so.
Calibration is one row a stratum and stays in Spark, for any number of strata; only that number reaches the
driver.

Measures of equality (lines, windows) compare hashes of two independent lanes, 128 bits.

Edge cases: a null text is empty (no words, so the base rule rejects it); a null ``lang`` is a stratum
of its own; labels with a null id or a quality other than 0 and 1 don't count; repeated rows are
judged each for itself; a null ``doc_id`` meets no label but is judged all the same; a very long text is measured
whole, in memory linear in its length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import cut, fields_of, row_of

SHAPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_bangs long"
NAMES = [x.split()[0] for x in SHAPE.split(", ")]

_SYMBOL, _UPPER, _LETTER = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _again(owner: np.ndarray, one: np.ndarray, other) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whether an equal one stands before) of all that occur twice or more under one owner.

    ``one`` is the first lane of hashes, ``other`` gives the second lane at some positions.
    """
    key = W.mix(one ^ (owner.astype(np.uint64) * W.STEP))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)]
    if not len(some):
        return some, np.zeros(0, bool)
    some = np.sort(some)
    keys = np.column_stack([owner[some].astype(np.uint64), one[some], other(some)])
    order = np.lexsort(keys.T[::-1])
    same = (keys[order][1:] == keys[order][:-1]).all(axis=1)
    later, twice = np.zeros(len(some), bool), np.zeros(len(some), bool)
    later[order[1:]] = same
    twice[order] = np.append(same, False) | np.append(False, same)
    return some[twice], later[twice]


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the texts of one block."""
    n = len(offs) - 1
    out = {k: np.zeros(n, np.int64) for k in NAMES}
    if not len(data):
        return out
    starts, ends, first = W.spans(data, offs)
    out["n_words"] = np.diff(first)
    inside = ~W.SPACE[data]
    out["word_chars"] = _per_text(inside & ((data & 0xC0) != 0x80), offs)
    out["n_symbols"] = _per_text(_SYMBOL[data], offs)
    out["n_upper"] = _per_text(_UPPER[data], offs)
    out["n_letters"] = _per_text(_LETTER[data], offs)
    out["n_bangs"] = _per_text(data == 33, offs)

    breaks = data == 10
    opening = np.zeros(len(data), bool)
    opening[1:] = breaks[:-1]
    opening[offs[:-1][offs[1:] > offs[:-1]]] = True
    l0 = np.flatnonzero(opening)
    l1 = np.append(l0[1:], len(data))
    l1 = np.where(breaks[l1 - 1], l1 - 1, l1)  # without the line break that ends it
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    with_word = seen[l1] > seen[l0]
    l0, l1 = l0[with_word], l1[with_word]
    doc = np.searchsorted(offs, l0, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    at, later = _again(doc, W.word_hashes(data, l0, l1), lambda i: W.word_hashes(data, l0[i], l1[i], 1))
    out["n_dup_lines"] = np.bincount(doc[at[later]], minlength=n)

    if len(starts):
        hashes = W.word_hashes(data, starts, ends)
        wide, ok = W.windows(hashes, first, 5)
        owner = np.repeat(np.arange(n), np.diff(first))
        whole = np.flatnonzero(ok)
        if len(whole):
            at, _ = _again(owner[whole], wide[whole], lambda i: W.windows(W.word_hashes(data, starts, ends, 1), first, 5)[0][whole[i]])
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, whole[at], 1)
            np.add.at(cover, whole[at] + 5, -1)
            out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _measured(column: pa.Array) -> pa.Array:
    data, offs = W.buffers(column)
    parts = [measure(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]) for a, z in W.blocks(offs)]
    fields = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), pa.int64()) for k in NAMES]
    out = pa.StructArray.from_arrays(fields, NAMES)
    W.release()
    return out


def measures(text: Column) -> Column:
    """Struct of the measures of a text."""

    @F.arrow_udf(returnType=f"struct<{', '.join(x.replace(' ', ': ') for x in SHAPE.split(', '))}>")
    def measured(t: pa.Array) -> pa.Array:
        return _measured(t)

    return measured.asNondeterministic()(text)  # else Spark would push a filter on measures below them and measure twice


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(f"m.{whole}") > 0, F.col(f"m.{part}") / F.col(f"m.{whole}")).otherwise(F.lit(0.0))


#: rule -> (measure, loosest cutoff, factor from one cutoff to the next tighter one)
RULES: dict[str, tuple] = {
    "symbols": (lambda: _share("n_symbols", "n_words"), 4.0, 0.8),
    "capitals": (lambda: _share("n_upper", "n_letters"), 0.98, 0.88),
    "bangs": (lambda: _share("n_bangs", "n_words"), 2.0, 0.8),
    "dup_lines": (lambda: _share("n_dup_lines", "n_lines"), 0.95, 0.88),
    "repeats": (lambda: _share("n_repeat_words", "n_words"), 0.95, 0.88),
    "word_length": (lambda: _share("word_chars", "n_words"), 40.0, 0.9),
}
STEPS = 20


def grid(rule: str) -> list[float]:
    _, top, factor = RULES[rule]
    return [top * factor**i for i in range(STEPS)]


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def holds(k: int, n: int, risk: float, level: float) -> bool:
    """Whether k rejections among n good texts show a rate of at most ``risk`` at this level."""
    return n > 0 and k <= n * risk and tail(k, n, risk) <= level


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def _step(stratum: tuple, risk: float, level: float) -> int | None:
    """The step taken, from the numbers of good texts, and of good and bad ones lost at each step."""
    good, lost, caught = stratum
    best, out = 0, None
    for i in range(STEPS):
        if not holds(lost[i], good, risk, level):
            break
        if caught[i] > best and caught[i] > lost[i]:
            best, out = caught[i], i
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, step) from ``measured`` (doc_id, stratum, digest, m) and ``labels``; null where no step holds."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = measured.where(~base_failed()).join(marks, "doc_id").groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), F.first("m").alias("m"))
    broken = F.array(*[breaks(F.lit(i)) for i in range(STEPS)])
    texts = texts.select("stratum", "quality", broken.alias("broken"))

    def number(quality: int) -> Column:
        return F.array(*[F.count(F.when((F.col("quality") == quality) & F.col("broken")[i], 1)) for i in range(STEPS)])

    table = cut(texts.groupBy("stratum").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), number(1).alias("lost"), number(0).alias("caught")))
    level = delta / max(1, table.count())

    @F.arrow_udf(returnType="int")
    def step(good: pa.Array, lost: pa.Array, caught: pa.Array) -> pa.Array:
        return pa.array([_step(x, risk, level) for x in zip(good.to_pylist(), lost.to_pylist(), caught.to_pylist(), strict=True)], pa.int32())

    return cut(table.select("stratum", step("good", "lost", "caught").alias("step")))


def _over(rule: str, step: Column) -> Column:
    return RULES[rule][0]() > F.element_at(F.array(*[F.lit(float(c)) for c in grid(rule)]), step + 1)


def breaks(step: Column) -> Column:
    """Whether a row with measures ``m`` breaks any rule at a step."""
    out = F.lit(False)
    for rule in RULES:
        out = out | _over(rule, step)
    return out


def failed_rules(step: Column) -> Column:
    """Names of the rules that a row with measures ``m`` breaks at a step; none where it is null."""
    return F.array_compact(F.array(*[F.when(_over(rule, step), F.lit(rule)) for rule in RULES]))


def _verdict(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """``rows`` (stratum, m, others) with base_failed, failed (names) and kept. The steps are a table of known size, one
    row a stratum: Spark broadcasts it where it is small."""
    out = rows.join(steps, "stratum", "left")
    return out.withColumns({"base_failed": base_failed(), "failed": failed_rules(F.col("step"))}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def _measures_of(docs: DataFrame, *columns) -> DataFrame:
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    return docs.select(*columns, stratum.alias("stratum"), measures(F.col("text")).alias("m"))


def _table(docs: DataFrame) -> DataFrame:
    return cut(_measures_of(docs, F.col("doc_id").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))


def judged(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """doc_id, the measures in ``m``, base_failed, failed (names) and kept for every row of ``docs``.

    Texts are read once; the measures, a few numbers a row, are kept as a table in the shared folder for both the
    calibration and the verdict."""
    measured = _table(docs)
    return _verdict(measured, calibrate(measured, labels, **risk)).select("doc_id", "m", "base_failed", "failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are. Texts are measured a second time,
    which takes less memory and disk than to keep or move them."""
    return _verdict(_measures_of(docs, row_of(docs)), calibrate(_table(docs), labels, **risk)).where("kept").select(*fields_of(docs))
