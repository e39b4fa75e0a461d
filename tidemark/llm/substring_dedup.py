"""Substring dedup by recompression.

Recompression names, round by round, the runs of equal symbols and then pairs of a left and a right
symbol, the side being a bit of the symbol's own name. Names are hashes of what they stand for, so they
are global without any exchange: every executor gives equal content the same name in every round.
Equal substrings hence get the same symbols except near their ends, where a run or pair may reach
outside. Popping in each round the end symbols that could (the first and last run; a first right or
last left symbol) leaves a sequence of symbols that depends on the substring alone. Its hash is the
substring's key. All windows of ``size`` words get keys this way at once.

Spark works in two rounds over documents dealt into cells by id. First each cell sends the keys of its windows,
cut to 40 bits, to buckets by key; a bucket answers which of them more than one cell has. These shared
symbols reveal what may repeat. Then each cell sends of such windows (and of those that it has twice itself) digests of
their words, 128 bits of two independent lanes, once a cell and with the least id there; a bucket finds for each digest
the least id over the corpus and answers which are repeats. So the digests decide, and a chance
agreement of keys only costs a question. The cell, which comes with its texts from the same shuffle,
removes the words that repeated windows cover. The number of cells follows the bytes of the texts, and a task holds
one cell or one bucket. A hot passage is one key a cell, never a pair.

Edge cases: a null text has no words; windows don't cross documents; texts under ``size`` words lose
nothing; a very long text is one cell's; rows with one id don't make each other repeats; a null id neither takes part
nor loses words; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import text_of, width

SIZE = 13
BLOCK = 1 << 19
CELL_BYTES = 32 << 20
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def window_keys(hashes: np.ndarray, first: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(start word, key) of every window of ``size`` words, from the words' hashes and the texts' first words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    starts = np.flatnonzero(np.arange(n) + size <= first[1:][owner])
    key = np.zeros(len(starts), np.uint64)
    sym, left, right = hashes, starts.copy(), starts + size
    lsig, rsig = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    turn = 0
    while len(live):
        turn += 1
        # runs
        m = len(sym)
        opens = np.ones(m, bool)
        opens[1:] = (sym[1:] != sym[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(opens)
        runs = len(begin) < m
        if runs:
            stop = np.append(begin[1:], m)
            run = np.cumsum(opens) - 1
            end = np.minimum(stop[run[left]], right)
        else:
            end = left + 1
        lsig = W.mix(lsig * _A + sym[left] + (end - left).astype(np.uint64) * _C)
        left = end
        some = left < right
        if runs:
            back = np.maximum(begin[run[np.maximum(right - 1, 0)]], left)
        else:
            back = right - 1
        took = W.mix(rsig * _B + sym[np.maximum(right - 1, 0)] + (right - back).astype(np.uint64) * _C)
        rsig, right = np.where(some, took, rsig), np.where(some, back, right)
        if runs:
            size_of = stop - begin
            left, right = np.where(left < m, run[np.minimum(left, m - 1)], len(begin)), np.where(right < m, run[np.minimum(right, m - 1)], len(begin))
            sym = np.where(size_of > 1, W.mix(sym[begin] * _D + size_of.astype(np.uint64)), sym[begin])
            owner = owner[begin]
        # pairs: the side is a bit of the name mixed with the round
        m = len(sym)
        side = (W.mix(sym + np.uint64(turn) * _C) & np.uint64(1)).astype(bool)
        some = left < right
        out = some & side[np.minimum(left, m - 1)]
        lsig = np.where(out, W.mix(lsig * _A + sym[np.minimum(left, m - 1)] + _D), lsig)
        left = left + out
        some = left < right
        out = some & ~side[np.maximum(right - 1, 0)]
        rsig = np.where(out, W.mix(rsig * _B + sym[np.maximum(right - 1, 0)] + _D), rsig)
        right = right - out
        second = np.zeros(m, bool)
        second[1:] = ~side[:-1] & side[1:] & (owner[1:] == owner[:-1])
        gone = np.zeros(m + 1, np.int64)
        np.cumsum(second, out=gone[1:])
        head = np.flatnonzero(~second)
        joined = np.zeros(m, bool)
        joined[:-1] = second[1:]
        named = W.mix(sym * _A + np.append(sym[1:], np.uint64(0)) * _B + _C)
        sym = np.where(joined, named, sym)[head]
        owner = owner[head]
        left, right = left - gone[left], right - gone[right]
        over = left >= right
        if over.any():
            key[live[over]] = W.mix(lsig[over] * _C + rsig[over] * _D)
            keep = ~over
            live, left, right, lsig, rsig = live[keep], left[keep], right[keep], lsig[keep], rsig[keep]
    return starts, key


def _sorted(table: pa.Table) -> pa.Table:
    """The rows with an id, by id."""
    table = table.filter(table.column("doc_id").is_valid())
    ids = table.column("doc_id").to_numpy(zero_copy_only=False)
    return table.take(pa.array(np.argsort(ids, kind="stable")))


class Cell:
    """The texts of a cell by id, as blocks of words; windows are numbered through all blocks."""

    def __init__(self, table: pa.Table, size: int):
        named = _sorted(table)
        self.size, self.ids, self.blocks = size, named.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), []
        bytes_, offs = W.buffers(named.column("text"))
        for a, z in W.blocks(offs, BLOCK):
            data, o = bytes_[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
            starts, ends, first = W.spans(data, o)
            owner = np.repeat(np.arange(z - a), np.diff(first))
            at = np.flatnonzero(np.arange(len(starts)) + size <= first[1:][owner]) if len(starts) else np.zeros(0, np.int64)
            self.blocks.append((a, z, data, starts, ends, first, at, a + owner[at]))

    def shared(self, buckets: int):
        """The distinct keys by bucket, the bounds of the buckets, and each window's place among the keys."""
        keys = [window_keys(W.word_hashes(data, starts, ends), first, self.size)[1] for _, _, data, starts, ends, first, _, _ in self.blocks]
        own, at, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        bucket = (own % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(own), np.int64)
        place[by] = np.arange(len(own))
        return own[by], np.searchsorted(bucket[by], np.arange(buckets + 1)), place[at], count[by]

    def digests(self, marked: np.ndarray, buckets: int):
        """Of the marked windows: the rows they stand in and, by digest, their order, which of them is the first of its
        digest, those firsts by bucket and the bounds of the buckets, and both lanes. Alike when sending and when told."""
        lanes, owners, done = ([], []), [], 0
        for _, _, data, starts, ends, first, at, owner in self.blocks:
            own = marked[done : done + len(at)]
            done += len(at)
            owners.append(owner[own])
            for lane, out in enumerate(lanes):
                out.append(W.windows(W.word_hashes(data, starts, ends, lane), first, self.size)[0][at[own]] if own.any() else np.zeros(0, np.uint64))
        one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in lanes)
        order = np.lexsort((two, one))  # stable: rows are in the order of ids
        lead = np.ones(len(order), bool)
        lead[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        firsts = order[lead]
        bucket = (one[firsts] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        return owners, order, lead, firsts[by], np.searchsorted(bucket[by], np.arange(buckets + 1)), one, two


ASKED = "cell int, bucket int, keys binary, owners binary"
TOLD = "cell int, bucket int, told binary"


def _bits(table: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """The answers of all buckets, in the order in which the questions were sent."""
    out = np.zeros(int(bounds[-1]), bool)
    for bucket, blob in zip(table.column("bucket").to_pylist(), table.column("told").to_pylist(), strict=True):
        if bucket >= 0:
            a, z = bounds[bucket], bounds[bucket + 1]
            out[a:z] = np.unpackbits(np.frombuffer(blob, np.uint8), count=z - a).astype(bool)
    return out


def _questions(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["cell", "bucket", "keys", "owners"])


def _reveals(size: int, buckets: int):
    """Keys of a cell, five bytes of what the bucket's number doesn't tell."""

    def run(table: pa.Table) -> pa.Table:
        keys, bounds, _, _ = Cell(table, size).shared(buckets)
        five = np.ascontiguousarray((keys // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :5])
        cell = table.column("cell")[0].as_py()
        return _questions([(cell, i, five[bounds[i] : bounds[i + 1]].tobytes(), None) for i in range(buckets) if bounds[i] < bounds[i + 1]])

    return run


def _shared(blobs: list[bytes], owners: list) -> list[np.ndarray]:
    """Of each blob, which keys stand in another one too."""
    parts = [np.frombuffer(b, np.uint8).reshape(-1, 5) for b in blobs]
    wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
    wide[:, :5] = np.concatenate(parts)
    keys = wide.view(np.uint64).ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def _verifies(size: int, buckets: int):
    """Digests of the windows that may repeat, with the least id of each; and, to the cell itself, which windows these are."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        cell = Cell(docs, size)
        keys, bounds, place, count = cell.shared(buckets)
        marked = (_bits(answers, bounds) | (count > 1))[place] if len(keys) else np.zeros(0, bool)
        owners, _, _, firsts, bounds, one, two = cell.digests(marked, buckets)
        number = docs.column("cell")[0].as_py()
        rows = [(number, -1 - number, np.packbits(marked).tobytes(), None)]
        for i in range(buckets):
            f = firsts[bounds[i] : bounds[i + 1]]
            if len(f):
                rows.append((number, i, np.column_stack([one[f], two[f]]).tobytes(), _ids_of(cell.ids[owners[f]])))
        return _questions(rows)

    return run


def _ids_of(ids: np.ndarray) -> bytes:
    """Ids as the distinct ones and an index of two or four bytes each."""
    own, at = np.unique(ids, return_inverse=True)
    return len(own).to_bytes(4, "little") + own.tobytes() + at.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes()


def _ids_back(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    own = np.frombuffer(blob, np.int64, n, 4)
    return own[np.frombuffer(blob, np.uint16 if n < 1 << 16 else np.uint32, offset=4 + 8 * n)]


def _later(blobs: list[bytes], owners: list[bytes]) -> list[np.ndarray]:
    """Of each blob, which digests a smaller id has."""
    parts = [np.frombuffer(b, np.uint64).reshape(-1, 2) for b in blobs]
    keys, ids = np.concatenate(parts), np.concatenate([_ids_back(o) for o in owners])
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    k, d = keys[order], ids[order]
    lead = np.ones(len(k), bool)
    lead[1:] = (k[1:] != k[:-1]).any(axis=1)
    out = np.zeros(len(k), bool)
    out[order] = d > d[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def _answered(decide):
    """Rows sorted by bucket: one bucket's questions at a time; what a cell sends itself passes."""

    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def out() -> pa.RecordBatch:
            cells, blobs, owners = zip(*held, strict=True)
            told = [blobs[0]] if now < 0 else [np.packbits(x).tobytes() for x in decide(list(blobs), list(owners))]
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([now] * len(cells), pa.int32()), pa.array(told, pa.binary())], ["cell", "bucket", "told"])

        for batch in batches:
            for cell, bucket, keys, owners in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                held.append((cell, keys, owners))
        if held:
            yield out()

    return run


def _removed(size: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        cell = Cell(docs, size)
        windows = sum(len(b[6]) for b in cell.blocks)
        own = next((t for b, t in zip(answers.column("bucket").to_pylist(), answers.column("told").to_pylist(), strict=True) if b < 0), b"")
        marked = np.unpackbits(np.frombuffer(own, np.uint8), count=windows).astype(bool)
        owners, order, lead, firsts, bounds, _, _ = cell.digests(marked, buckets)
        told = np.zeros(len(order), bool)
        told[firsts] = _bits(answers, bounds)
        # a window is a repeat if its digest is one elsewhere, or if a smaller id of this cell has it
        head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(order) else order
        later = np.zeros(len(order), bool)
        later[order] = told[head] | (cell.ids[owners[order]] > cell.ids[owners[head]])
        repeat = np.zeros(windows, bool)
        repeat[marked] = later
        rows: list[tuple] = []
        done = 0
        for a, z, data, starts, ends, first, at, _ in cell.blocks:
            cover = np.zeros(len(starts) + 1, np.int64)
            hit = at[repeat[done : done + len(at)]]
            done += len(at)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + size, -1)
            gone = np.cumsum(cover)[:-1] > 0
            raw = data.tobytes()
            for i in range(z - a):
                s, e = int(first[i]), int(first[i + 1])
                kept = [raw[starts[w] : ends[w]] for w in (np.flatnonzero(~gone[s:e]) + s).tolist()]
                rows.append((int(cell.ids[a + i]), e - s, e - s - len(kept), b" ".join(kept)))
        for t in docs.filter(docs.column("doc_id").is_null()).column("text").to_pylist():
            data, o = W.buffers(pa.array([t], pa.string()))
            s, e, _ = W.spans(data, o)
            rows.append((None, len(s), 0, b" ".join([data[i:j].tobytes() for i, j in zip(s, e, strict=True)])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.table([*cols[:3], cols[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(docs: DataFrame, size: int = SIZE, cells_a_partition: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces) of every row."""
    n = width(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = max(n * cells_a_partition, -(-total // CELL_BYTES)), max(n, -(-total // CELL_BYTES))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.pmod(spread, F.lit(cells)).cast("int").alias("cell"))

    def answers(asked: DataFrame, decide) -> DataFrame:
        # every bucket has its partition: cells and buckets make as many questions as their product, so buckets are few
        return asked.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket").mapInArrow(_answered(decide), TOLD)

    revealed = answers(rows.groupBy("cell").applyInArrow(_reveals(size, buckets), ASKED), _shared)
    verified = answers(rows.groupBy("cell").cogroup(revealed.groupBy("cell")).applyInArrow(_verifies(size, buckets), ASKED), _later)
    return rows.groupBy("cell").cogroup(verified.groupBy("cell")).applyInArrow(_removed(size, buckets), "doc_id long, n_words long, n_removed long, kept string")
