"""Improbable-feature digests of documents.

Features are byte windows. A window's rarity is how far its byte entropy lies from what running text
usually has (a constant, so that fingerprints of different corpora compare); windows of low entropy (padding, repeats)
are never features. In every neighbourhood of
consecutive windows the rarest wins (the first of equals), and windows that win often enough are
selected. Selected windows go, five bits each, into a chain of Bloom filters of 256 bytes that takes a
new filter after every 160 features. Two fingerprints are compared filter by filter: the overlap of
their bits, less what chance gives, over the most that could overlap; each filter of the shorter chain
takes its best partner, weighted by its features.

A text of under 64 bytes has all its 4-byte windows as features, one of under 4 bytes itself; an empty
text has none. A longer text all of low entropy, where nothing is selected, has its different 4-byte windows. Two
empty fingerprints are alike (1.0), an empty one is like no other (0.0).

``edited`` pairs each text with the next one by descending id without a global sort: ids alone give
quantile bounds and each range's first row, texts are shuffled once by range, and the row that the
range above needs as its last one's successor travels there as well. A range is sorted and streamed, so a task
holds a batch of texts, however many a range has.

Edge cases: a null text is empty; a very long text is one row of a batch; null ids come last in descending order; rows
with one id, or without, follow each other by a hash of the text; a table of one row is its own successor.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import width

WINDOW = 16
NEAR = 16
WINS = 4
SHORT = 64
GRAM = 4
USUAL = 770
LOW = 450
BITS = 2048
FULL = 160
HASHES = 5
PAIRED = 1 << 22  # characters that are paired at a time

#: c * log2(c) in fixed point: sums of it are exact, so a window's entropy doesn't depend on what stands around it
_F = np.rint(np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))]) * (1 << 24)).astype(np.int64)


def _entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of the most possible, of the window that starts at each byte."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    group = data[order].astype(np.int64) * n
    key = group + order
    at = np.arange(n)
    back, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    back[order] = at - np.searchsorted(key, np.maximum(key - (WINDOW - 1), group)) + 1
    ahead[order] = np.searchsorted(key, np.minimum(key + (WINDOW - 1), group + n - 1), side="right") - at
    change = _F[np.minimum(back, WINDOW)] - _F[np.minimum(back, WINDOW) - 1]
    change[WINDOW:] += (_F[ahead - 1] - _F[ahead])[: n - WINDOW]
    return 1000 - np.cumsum(change)[WINDOW - 1 :] * 1000 // _F[WINDOW]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected features of the texts of a block, in text order."""
    docs, hashes = [], []
    n = len(data)
    lens = np.diff(offs)
    if (lens >= SHORT).any():
        q = _entropies(data)
        starts = np.arange(len(q))
        worth = np.where(q < LOW, 0, np.abs(q - USUAL) + 1)
        rank = ((np.int64(2000) - worth) << np.int64(40)) | starts
        best, span = rank, 1
        while span < NEAR and len(best) > span:
            best = np.minimum(best[: len(best) - span], best[span:])
            span *= 2
        owner = np.repeat(np.arange(len(lens)), lens)[: len(q)]
        last = offs[1:][owner] - WINDOW  # last start of a window in the text
        votes = np.zeros(len(q), np.int64)
        if span == NEAR:
            whole = best[starts[: len(best)] + NEAR - 1 <= last[: len(best)]]
            votes += np.bincount(whole & ((1 << 40) - 1), minlength=len(q))
        chosen = votes >= WINS
        chosen &= (worth > 0) & (lens >= SHORT)[owner]
        at = np.flatnonzero(chosen)
        docs.append(owner[at])
        hashes.append(W.word_hashes(data, at, at + WINDOW))
        for i in np.flatnonzero((lens >= SHORT) & (np.bincount(owner[at], minlength=len(lens)) == 0)).tolist():
            grams = np.ndarray((int(lens[i]) - GRAM + 1,), "<u4", data[offs[i] : offs[i + 1]].tobytes(), 0, (1,))
            first = offs[i] + np.sort(np.unique(grams, return_index=True)[1])
            docs.append(np.full(len(first), i))
            hashes.append(W.word_hashes(data, first, first + GRAM))
    short = np.flatnonzero((lens >= GRAM) & (lens < SHORT))
    if len(short):
        grams = lens[short] - GRAM + 1
        at = np.repeat(offs[short] - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams) + np.arange(grams.sum())
        docs.append(np.repeat(short, grams))
        hashes.append(W.word_hashes(data, at, at + GRAM))
    tiny = np.flatnonzero((lens > 0) & (lens < GRAM))
    if len(tiny):
        docs.append(tiny)
        hashes.append(W.word_hashes(data, offs[tiny], offs[tiny + 1]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def digests(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features in each filter, filters as rows of 32 words) of each text."""
    n = len(offs) - 1
    doc, h = features(data, offs)
    count = np.bincount(doc, minlength=n)
    filters = -(-count // FULL)
    first_filter = np.concatenate([[0], np.cumsum(filters)])
    ordinal = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)])[doc]
    slot = first_filter[doc] + ordinal // FULL
    bits = np.zeros((int(first_filter[-1]), BITS), bool)
    for j in range(HASHES):
        bits[slot, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64) if len(bits) else np.zeros((0, BITS // 64), np.uint64)
    sizes = np.bincount(slot, minlength=len(packed))
    return [(sizes[a:z], packed[a:z]) for a, z in zip(first_filter[:-1], first_filter[1:], strict=True)]


def text_form(digest: tuple[np.ndarray, np.ndarray]) -> str:
    sizes, filters = digest
    return base64.b64encode(sizes.astype(">u2").tobytes() + filters.tobytes()).decode()


def from_text(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(s)
    n = len(raw) // (2 + BITS // 8)
    return np.frombuffer(raw[: 2 * n], ">u2").astype(np.int64), np.frombuffer(raw[2 * n :], np.uint64).reshape(n, BITS // 64)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1."""
    (sx, fx), (sy, fy) = x, y
    if not len(fx) or not len(fy):
        return float(len(fx) == len(fy))
    if len(fx) > len(fy):
        (sx, fx), (sy, fy) = (sy, fy), (sx, fx)
    both = np.bitwise_count(fx[:, None, :] & fy[None, :, :]).sum(axis=2, dtype=np.float64)
    nx, ny = (np.bitwise_count(f).sum(axis=1, dtype=np.float64) for f in (fx, fy))
    chance, most = nx[:, None] * ny[None, :] / BITS, np.minimum(nx[:, None], ny[None, :])
    score = np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both >= most)
    return float(np.clip(np.average(np.clip(score, 0, 1).max(axis=1), weights=sx), 0, 1))


def of_texts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offs = W.buffers(pa.array(texts, pa.string()))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, z in W.blocks(offs):
        out += digests(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_form(d) for d in of_texts(texts)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_OUT = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _paired(rows: list[tuple]) -> pa.RecordBatch:
    """Each row but the last with the one after it; rows are (id, text)."""
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
    plain, changed = of_texts(texts), of_texts(edited)
    n = len(edited)
    cols = [
        pa.array([i for i, _ in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(edited, pa.string()), pa.array([text_form(d) for d in plain[:n]], pa.string()),
        pa.array([text_form(d) for d in changed], pa.string()), pa.array([likeness(plain[k], changed[k]) for k in range(n)], pa.float64()), pa.array([likeness(plain[k], plain[k + 1]) for k in range(n)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, _OUT)


@W.released
def _pairs(batches):
    """Rows sorted by range, guests last, then order: each own row with the next one; the first guest follows the last."""
    last, ended = None, False  # the last row whose successor is awaited, and whether its range has had its guest
    for b in batches:
        held: list[tuple] = []
        size = 0
        for guest, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if guest and ended:
                continue
            if not guest and ended:
                last, ended = None, False
            if last is not None:
                held.append((last, (key, text or "")))
                size += len(held[-1][1][1])
            last, ended = (None, True) if guest else (held[-1][1] if held and last is not None else (key, text or ""), False)
            if size > PAIRED:
                yield from _runs(held)
                held, size = [], 0
        yield from _runs(held)


def _runs(pairs: list[tuple]):
    """Pairs that follow each other make one run of rows."""
    i = 0
    while i < len(pairs):
        j = i + 1
        while j < len(pairs) and pairs[j][0] is pairs[j - 1][1]:
            j += 1
        yield _paired([p[0] for p in pairs[i:j]] + [pairs[j - 1][1]])
        i = j


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), both fingerprints, and their likeness to each other and to the next text's."""
    n = width(docs.sparkSession)
    # ascending order of (no id, descending id, hash); without an id the lowest range is the row's
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("down"), F.xxhash64("text").alias("hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text"), order.alias("order"))
    cells = 2 * n
    bounds = rows.agg(F.percentile_approx("key", [i / cells for i in range(1, cells)], 20 * cells).alias("b")).first()["b"] or []
    edges = np.unique(np.array(bounds, np.int64))
    cell_of = F.arrow_udf(lambda k: pa.array(np.searchsorted(edges, k.to_numpy(zero_copy_only=False), side="left").astype(np.int32)), "int")
    rows = rows.withColumn("cell", F.when(F.col("key").isNull(), -1).otherwise(cell_of(F.coalesce("key", F.lit(0)))))
    firsts = sorted((r["cell"], r["first"]) for r in rows.groupBy("cell").agg(F.min("order").alias("first")).collect())  # one row a range
    above = [(firsts[(i + 1) % len(firsts)][0], first) for i, (_, first) in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame([(first, cell) for cell, first in above], "order struct<none:boolean,down:bigint,hash:bigint>, above int")
    rows = rows.join(F.broadcast(table), "order", "left")  # one row a range
    guest = F.array_compact(F.array(F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("cell"), F.lit(True).alias("guest")))))
    to = F.concat(F.array(F.struct("cell", F.lit(False).alias("guest"))), guest)
    dealt = rows.select("key", "text", "order", F.explode(to).alias("to")).select("to.cell", "to.guest", "key", "text", "order")
    dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell", "guest", "order", "text").select("guest", "key", "text")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
