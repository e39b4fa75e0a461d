"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set overlap decides.

Five-word shingles, Jaccard similarity of 0.8 or more. Equal texts fold into one text, texts with equal
shingle sets into one node. Every node has in each tree a label, a sequence of ``LONGEST`` MinHash values.
The labels of a tree, sorted, are its trie. Matched prefixes are shortened until the target recall: the
shortest prefix, ``depth_for`` values long, is the longest at which the trees, which share no MinHash value
up to there, bring a pair at the threshold together often enough. Nodes are dealt by tree and that
prefix, so a task holds whole subtries, sorted by the rest of the label; there a node is compared first with
the neighbours with which it shares the longest prefix, and where these are strangers with what
shorter and shorter prefixes bring to it, until its subtrie hangs together or the shortest prefix is reached
(``_ascended``). Comparisons are of one bit of each MinHash value, which travel with the labels. What hangs
together, over all trees, is a candidate group.

Subtries larger than a block are dealt into pairs of blocks, so no task holds one and no pair is lost.
Within each group all pairs are verified exactly, in blocks of bounded size: a task holds two blocks,
and only counts and stars of the verified links leave it, never the pairs.

Result: one row a document with ``class_id`` (the least doc_id of its class: the texts connected by
links) and ``n_links`` (the number of other, different texts within the threshold).

Edge cases: null and empty texts have no words, hence no shingles; such texts are only copies of
each other (equal text). A text with fewer than five words has one shingle of all its words. A very long text
is a set like others, in memory once. A null doc_id stands alone: class_id null, n_links 0. Repeated rows are
copies. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.links import components, roots
from tidemark.llm.shared import cut, fields_of, met, row_of, text_of, width

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 192
TREES = 32
LONGEST = 12
#: bits of two signatures that may differ: of 192 some 19 do at the threshold, with a deviation of 4.2
DIFFER = 40
BLOCK_SHINGLES = 400_000
BLOCK_NODES = 1024
BLOCK_LABELS = 4096
#: A prefix is dealt into blocks if it has more rows than a block and over this share of all: so few are, however many rows there are.
LARGE_SHARE = 1 / 200_000

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_OWN = HASHES // TREES


def _orders() -> np.ndarray:
    """Positions in the signature of each tree's label: the first ``_OWN`` are no other tree's."""
    out = []
    for first in _rng.permutation(HASHES).reshape(TREES, _OWN):
        rest = _rng.permutation(HASHES)
        out.append(np.concatenate([first, rest[~np.isin(rest, first)]])[:LONGEST])
    return np.array(out)


_ORDER = _orders()


def missed(depth: int, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at this similarity shares a prefix of ``depth`` values in no tree.

    Up to ``_OWN`` values the trees are independent. Longer prefixes draw on one signature, so what a pair
    misses depends on how many of its ``HASHES`` values agree: the mean over that binomial number.
    """
    if depth <= _OWN:
        return (1 - threshold**depth) ** TREES
    out = 0.0
    for m in range(HASHES + 1):
        p = math.exp(math.lgamma(HASHES + 1) - math.lgamma(m + 1) - math.lgamma(HASHES - m + 1) + m * math.log(threshold) + (HASHES - m) * math.log(1 - threshold))
        out += p * (1 - math.comb(m, depth) / math.comb(HASHES, depth)) ** TREES
    return out


def depth_for(recall: float, threshold: float = THRESHOLD) -> int:
    """The length down to which prefixes are shortened: the first, from the longest, that has this recall."""
    for depth in range(LONGEST, 1, -1):
        if missed(depth, threshold) <= 1 - recall:
            return depth
    return 1


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of 16 bits, a row for each non-empty set."""
    lens = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(((flat * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), at)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


@W.released
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text without words has its own digest for a set, and no signature."""
    for batch in batches:
        data, offs = W.buffers(batch.column(2))
        for a, z in W.blocks(offs):
            sets = W.shingle_sets(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], SHINGLE)
            some = [s for s in sets if len(s)]
            signed = iter(_signatures(some)) if some else iter(())
            texts = batch.column(1).slice(a, z - a)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"-" + t for s, t in zip(sets, texts.to_pylist(), strict=True)]
            sigs = [next(signed).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, z - a), texts, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_key", "set_key", "n_shingles", "sig"],
            )


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, size = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, kind, size: int) -> np.ndarray:
    """A binary column of rows of one length, as rows of numbers."""
    data, offs = W.buffers(column.cast(pa.binary()))
    return data.view(kind).reshape(len(offs) - 1, size) if size else np.zeros((len(offs) - 1, 0), kind)


def _hung(depth: int, keys_only: bool = False):
    """Of every node (node, sig), in every tree: the hash of tree and shortest prefix, the rest of its label, its bits."""

    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _rows(batch.column(1), np.uint16, HASHES)
            bits = None if keys_only else _binary(np.packbits((sig & 1).astype(np.uint8), axis=1))
            for t in range(TREES):
                acc = np.full(len(sig), t + 1, np.uint64)
                for j in _ORDER[t][:depth]:
                    acc = W.mix(acc * W.STEP + sig[:, j].astype(np.uint64))
                key = pa.array(acc.view(np.int64))
                if keys_only:
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                else:
                    rest = np.ascontiguousarray(sig[:, _ORDER[t][depth:]]).astype(">u2", order="C")
                    yield pa.RecordBatch.from_arrays([key, _binary(rest.view(np.uint8).reshape(len(sig), -1)), batch.column(0), bits], ["key", "rest", "node", "bits"])

    return run


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _ascended(rest: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Ties (i, j) of a spanning forest of the alike rows of one subtrie, sorted by the rest of the label.

    From whole labels to the shortest prefix: at each length, rows of different subtries that now share a
    prefix are compared, unless they hang together already; every pair of rows is met once at most.
    """
    m = len(bits)
    group, out = np.arange(m), []
    shared = np.cumprod(rest[1:] == rest[:-1], axis=1).sum(axis=1) if rest.shape[1] else np.zeros(m - 1, np.int64)

    def tie(i: int, j: int) -> None:
        out.append((i, j))
        group[group == group[j]] = group[i]

    for i in np.flatnonzero(_differ(bits[1:], bits[:-1]) <= DIFFER).tolist():  # neighbours share the longest prefixes
        tie(i, i + 1)
    child = np.arange(m)
    for length in range(rest.shape[1], -1, -1):
        if (group == group[0]).all():
            break
        parent = np.concatenate([[0], np.cumsum(shared < length)])
        edges = np.searchsorted(parent, np.arange(parent[-1] + 2))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if child[a] == child[z - 1] or (group[a:z] == group[a]).all():
                continue
            for i in range(a, z - 1):
                b = int(np.searchsorted(child, child[i], side="right"))
                if b >= z:
                    break
                for j in (np.flatnonzero((_differ(bits[i], bits[b:z]) <= DIFFER) & (group[b:z] != group[i])) + b).tolist():
                    if group[i] != group[j]:
                        tie(i, j)
        child = parent
    return out


@W.released
def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bi, bj, rest): the ties of every subtrie."""
    kept = None

    def done(key, rest, node, bits) -> pa.RecordBatch:
        same = (key[1:] == key[:-1]).all(axis=1)
        alike = same & (_differ(bits[1:], bits[:-1]) <= DIFFER)
        at = np.flatnonzero(alike)
        ties = [np.column_stack([node[at], node[at + 1]])]
        run = np.concatenate([[0], np.cumsum(~same)])
        for r in np.unique(run[:-1][same & ~alike]).tolist():  # a neighbour is a stranger
            a, z = np.searchsorted(run, [r, r + 1])
            found = _ascended(rest[a:z], bits[a:z])
            if found:
                ties.append(node[a:z][np.array(found)])
        u, v = roots(*np.concatenate(ties).T)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        size = len(batch.column(3)[0].as_py()) // 2
        now = [key, _rows(batch.column(3), np.uint16, size), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), _rows(batch.column(5), np.uint64, HASHES // 64)]
        kept = now if kept is None else [np.concatenate(p) for p in zip(kept, now, strict=True)]
        last = int(np.flatnonzero((kept[0] != kept[0][-1]).any(axis=1))[-1]) + 1 if (kept[0] != kept[0][-1]).any() else 0
        if last > 1:
            yield done(*[x[:last] for x in kept])
        kept = [x[last:] for x in kept]
    if kept is not None and len(kept[2]) > 1:
        yield done(*kept)


def _ties(nodes: DataFrame, depth: int, n_nodes: int) -> DataFrame:
    """(a, b): ties among nodes (node, sig) that share a prefix of ``depth`` values in some tree and are alike."""
    n = width(nodes.sparkSession)
    least = max(BLOCK_LABELS, int(n_nodes * TREES * LARGE_SHARE))
    large = nodes.mapInArrow(_hung(depth, True), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hung = nodes.mapInArrow(_hung(depth), "key long, rest binary, node long, bits binary").join(F.broadcast(large), "key", "left")  # 200,000 rows at most
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK_LABELS).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = hung.withColumn("side", side).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("side", "o").alias("bi"), F.greatest("side", "o").alias("bj"), "rest", "node", "bits")
    return dealt.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rest", "node").mapInArrow(_climbed, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(flat, sets):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == flat[ok]
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (lr, lc), (rr, rc) = cells(lv, left), cells(rv, right)
    step = 4096
    for c in range(0, len(both), step):
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        for m, r, k in ((a, lr, lc), (b, rr, rc)):
            s, e = np.searchsorted(k, [c, c + step])
            m[r[s:e], k[s:e] - c] = 1
        out += a @ b.T
    return out


@W.released
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (comp, bi, bj): each pair of blocks in turn; of every linked node the number of its links
    and the least node that it hangs together with there."""
    held, key = [], None

    def done():
        nodes, n_texts, sets, sides = (list(x) for x in zip(*held, strict=True))
        one = key[1] == key[2]
        li = [i for i, s in enumerate(sides) if s == key[1]]
        ri = li if one else [i for i, s in enumerate(sides) if s == key[2]]
        if not li or not ri or (one and len(li) < 2):
            return None
        common = _overlaps([sets[i] for i in li], [sets[i] for i in ri])
        sizes = np.array([len(s) for s in sets], np.float64)
        union = sizes[li][:, None] + sizes[ri][None, :] - common
        linked = common >= THRESHOLD * union - 1e-9
        if one:
            np.fill_diagonal(linked, False)
        node, many = np.array(nodes, np.int64), np.array(n_texts, np.int64)
        counts = np.zeros(len(node), np.int64)
        counts[li] += linked @ many[ri]
        if not one:
            counts[ri] += many[li] @ linked
        i, j = np.nonzero(linked)
        if not len(i):
            return None
        tops = dict(zip(*(x.tolist() for x in roots(node[li][i], node[ri][j])), strict=True))
        some = np.flatnonzero(counts)
        root = [tops.get(x, x) for x in node[some].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root, pa.int64()), pa.array(counts[some]), pa.array([key[3]] * len(some), pa.bool_())], ["node", "root", "links", "whole"])

    for batch in batches:
        comp, bi, bj, side, node, n_texts, blocks = (batch.column(i).to_pylist() for i in range(7))
        for i, blob in enumerate(batch.column(7)):
            now = (comp[i], bi[i], bj[i], blocks[i] == 1)
            if now != key:
                if held and (out := done()) is not None:
                    yield out
                held, key = [], now
            if held and held[-1][0] == node[i]:  # the same row of the table again
                continue
            held.append((node[i], n_texts[i], np.frombuffer(blob.as_py(), np.uint64), side[i]))
    if held and (out := done()) is not None:
        yield out


@W.released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its shingle set; the others pass through."""
    for batch in batches:
        k = batch.num_columns - 1
        data, offs = W.buffers(batch.column(k))
        for a, z in W.blocks(offs):
            sets = W.shingle_sets(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], SHINGLE)
            yield pa.RecordBatch.from_arrays([c.slice(a, z - a) for c in batch.columns[:k]] + [pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[:k], "shingles"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (digest of the whole text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_of())).alias("text_key"), text_of().alias("text"))


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root, links, whole) of the nodes (node, text_key, n_texts, n_shingles) of candidate groups (node, component)."""
    spark, n = docs.sparkSession, width(docs.sparkSession)
    member = cut(groups.join(nodes, "node"))
    sizes = member.groupBy("component").agg(F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = met(member, sizes, "component", "n", member.count()).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select(F.col("node").alias("doc_id"), "text_key", "component", "blocks", "side", "n_texts")
    sets = _keyed(docs).join(dealt, ["doc_id", "text_key"]).select("component", "blocks", "side", F.col("doc_id").alias("node"), "n_texts", "text").mapInArrow(
        _sets, "component long, blocks int, side int, node long, n_texts long, shingles binary"
    )
    pairs = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("side", "o").alias("bi"), F.greatest("side", "o").alias("bj"), "side", "node", "n_texts", "blocks", "shingles"
    )
    return pairs.repartition(n, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "node").mapInArrow(_verify, "node long, root long, links long, whole boolean")


def classes(docs: DataFrame, recall: float = 0.9995) -> DataFrame:
    """(doc_id, text_key, class_id, n_links) for every row of ``docs``."""
    rows = cut(_keyed(docs).mapInArrow(_sketch, "doc_id long, text_key binary, set_key binary, n_shingles long, sig binary"))
    texts = rows.where("doc_id is not null").groupBy("set_key", "text_key").agg(F.min("doc_id").alias("text_rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = texts.groupBy("set_key").agg(F.min(F.struct("text_rep", "text_key")).alias("rep"), F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select("set_key", F.col("rep.text_rep").alias("node"), F.col("rep.text_key").alias("text_key"), "n_texts", "n_rows", "n_shingles", "sig"))
    some = nodes.where("sig is not null")
    n_nodes, n_rows = nodes.agg(F.count("sig"), F.sum("n_rows")).first()

    groups = components(_ties(some.select("node", "sig"), depth_for(recall), n_nodes), stars_already=True)
    found = cut(_verified(docs, some.select("node", "text_key", "n_texts", "n_shingles"), groups))
    # groups of one block are done; what hangs together over several blocks is found by its stars
    wide = components(found.where("not whole"), "node", "root")
    told = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root")).join(wide, "node", "left")
    by_set = nodes.select("set_key", "node", "n_texts", "n_rows").join(told, "node", "left").select(
        "set_key", "n_rows", F.coalesce("component", "root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links")
    )
    named = met(rows.where("doc_id is not null").select("doc_id", "text_key", "set_key"), by_set, "set_key", "n_rows", n_rows or 0)
    alone = rows.where("doc_id is null").select("doc_id", "text_key", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.select("doc_id", "text_key", "class_id", F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def deduplicated(docs: DataFrame, recall: float = 0.9995) -> DataFrame:
    """One document of each class: the one with the least doc_id. Rows with a null doc_id all stay;
    of repeated rows with one doc_id one stays."""
    # of a class's equal texts with the least doc_id there may be several rows, and of its other texts with that doc_id
    least = classes(docs, recall).where("doc_id = class_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_of())).alias("text_key"))
    kept = rows.where("doc_id is not null").join(least, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.select(*fields_of(docs)).unionByName(docs.where("doc_id is null"))
