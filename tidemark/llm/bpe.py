"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it into chunks, at the same places wherever the same
passage stands, whatever surrounds it. A chunk's inner part, from its first to its last white space,
is encoded once; a process keeps what it has encoded (a bounded store that outlives tasks) and reuses
it for every later text that shares the chunk. At a join the cut may have split a word, so what
stands between the last white space of one chunk and the first of the next is encoded again as one
piece. White space is where every encoding agrees with that of the whole text (the tokenizer's
normaliser maps it to one space, its splits never cross it, nothing composes with it), so the piece is
grown over as many chunks as it takes to reach white space on both sides, and the result is exact.
New inner parts are looked up word by word in a second bounded store before the tokenizer is called.
Both stores are bounded in bytes: a short word and its ids are one object at one of a fixed number of places,
chunks and long words have a room each. What is worked on at once is bounded too (``block`` bytes of text, hashed
by slices), a single longer text aside.

Only the bytes of texts count: no shuffle, nothing broadcast. The tokenizer file is a parameter and
read once a process; executors must have it at that path.

Edge cases: a null text is empty and has no ids; a text without white space is one piece; a null
doc_id, repeated rows and further columns pass unchanged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

MASK = np.uint64((1 << 10) - 1)
LEAST = 256
ROLL = 16
LONG = 1 << 14
SLICE = 1 << 16
#: bytes of words that have places of their own
SHORT = 24
#: bytes of what a store holds newly, by estimate; as much again may be older
WORD_ROOM = 8 << 20
CHUNK_ROOM = 12 << 20
#: bytes that an entry takes besides its own: two objects' heads and a place in a dict
ENTRY = 150

_state: dict = {}


class Store:
    """What was put last: up to twice ``size`` entries of twice ``room`` bytes; none has a key of over ``LONG`` bytes."""

    def __init__(self, size: int, room: int):
        self.size, self.room, self.used, self.new, self.old = size, room, 0, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(key) > LONG:
            return
        takes = ENTRY + len(key) + (len(value) if isinstance(value, bytes) else sum(len(x) for x in value if x))
        if self.new and (len(self.new) >= self.size or self.used + takes > self.room):
            self.old, self.new, self.used = self.new, {}, 0
        self.new[key] = value
        self.used += takes


class Words:
    """Ids of words. A short word's stand behind it and a space (which no word has) at the place that its hash gives;
    there the word put last stays."""

    def __init__(self, size: int):
        self.size, self.places, self.long = size, [b""] * size, Store(size, WORD_ROOM)

    def get(self, word: bytes):
        n = len(word)
        if n > SHORT:
            return self.long.get(word)
        x = self.places[hash(word) % self.size]
        return x[n + 1 :] if x.startswith(word) and x[n : n + 1] == b" " else None

    def put(self, word: bytes, ids: bytes) -> None:
        if len(word) > SHORT:
            self.long.put(word, ids)
        else:
            self.places[hash(word) % self.size] = b"%b %b" % (word, ids)


class Encoder:
    def __init__(self, path: str, words: int = 1 << 19, chunks: int = 2_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = pa.array([self.tokenizer.id_to_token(i) or "" for i in range(n)], pa.string())
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized) and len(t.content) > 2]
        self.between_id, self.between = special[0] if special else (None, None)
        # a word with the special token's first or last character may run together with it
        self.mark = self.between.encode()[:1] if special else b""
        self.words, self.chunks = Words(words), Store(chunks, CHUNK_ROOM)
        self.reused = self.fresh = 0

    def coded(self, ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """What the tokenizer's decode gives: it has no decoder, so pieces are joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.pieces.take(lists.values)), " ")

    def learn(self, new: set[bytes]) -> dict:
        """Encode words that the store hasn't got; all of them, also if the store can't hold them."""
        out, todo = {}, []
        for w in new:
            if self.between is None or self.mark in w or self.between.encode()[-1:] in w:
                out[w] = self.coded(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids)
            else:
                todo.append(w)
        for i in range(0, len(todo), 512):  # many words a call, a special token between them
            own = todo[i : i + 512]
            ids, last, parts = self.tokenizer.encode(self.between.join([w.decode() for w in own]), add_special_tokens=False).ids, 0, []
            at = [k for k, x in enumerate(ids) if x == self.between_id]
            for k in [*at, len(ids)]:
                parts.append(ids[last:k])
                last = k + 1
            for w, x in zip(own, parts, strict=True):
                out[w] = self.coded(x)
        for w, v in out.items():
            self.words.put(w, v)
        return out

    def inner(self, parts: list[list[bytes]]) -> list[bytes]:
        """Ids, as bytes, of lists of words."""
        ids, missing = {}, set()
        for w in set(chain.from_iterable(parts)):
            v = self.words.get(w)
            if v is None:
                missing.add(w)
            else:
                ids[w] = v
        ids.update(self.learn(missing))
        one = ids.__getitem__
        return [b"".join(map(one, ws)) for ws in parts]

    def block(self, raw: bytes, chunks: list[list[tuple[int, int]]]) -> list[bytes]:
        """Ids, as bytes, of texts given as lists of chunk ranges."""
        plan, fresh = [], {}
        for ranges in chunks:
            own, glue = [], b""
            for a, z in ranges:
                piece = raw[a:z]
                entry = self.chunks.get(piece) or fresh.get(piece)
                if entry is None:
                    self.fresh += 1
                    cuts = _white(piece)
                    entry = [piece, b"", None] if cuts is None else [piece[: cuts[0]], piece[cuts[1] :], piece[cuts[0] : cuts[1]].split()]
                    fresh[piece] = entry
                else:
                    self.reused += 1
                if entry[2] is None:  # no white space: the join grows over it
                    glue += entry[0]
                    continue
                join = glue + entry[0]
                if join:
                    own.append((False, join.split()))
                own.append((True, entry))
                glue = entry[1]
            if glue:
                own.append((False, glue.split()))
            plan.append(own)
        for entry, coded in zip(new := [e for e in fresh.values() if e[2]], self.inner([e[2] for e in new]), strict=True):
            entry[2] = coded
        for piece, entry in fresh.items():
            if isinstance(entry[2], list):
                entry[2] = b""
            self.chunks.put(piece, entry)
        joins = iter(self.inner([x for own in plan for whole, x in own if not whole]))
        return [b"".join([x[2] if whole else next(joins) for whole, x in own]) for own in plan]


def _white(piece: bytes) -> tuple[int, int] | None:
    """First white space and end of the last one, of space and line break."""
    first = min((i for i in (piece.find(b" "), piece.find(b"\n")) if i >= 0), default=-1)
    if first < 0:
        return None
    return first, max(piece.rfind(b" "), piece.rfind(b"\n")) + 1


def cuts(data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int]]]:
    """Chunk ranges of each text: a cut stands before a character where the hash of the 16 bytes
    before it has ten low bits of zero, at least ``LEAST`` bytes after the last."""
    n = len(data)
    at, out = np.concatenate([np.zeros(0, np.int64), *(_hits(data, lo) for lo in range(0, n if n > ROLL else 0, SLICE))]), []
    for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own, last = [], a
        lo, hi = np.searchsorted(at, [a + LEAST, z])
        for c in at[lo:hi].tolist():
            if c - last >= LEAST:
                own.append((last, c))
                last = c
        if z > last:
            own.append((last, z))
        out.append(own)
    return out


def _hits(data: np.ndarray, lo: int) -> np.ndarray:
    """Places of cuts after the bytes of the slice from ``lo`` on, which is hashed with what stands before it."""
    first, end = max(0, lo - ROLL + 1), min(lo + SLICE, len(data))
    h = data[first:end].astype(np.uint64) + np.uint64(1)
    step, width = int(W.BASE), 1
    while width < ROLL:
        h[width:] = h[width:] + np.uint64(pow(step, width, 1 << 64)) * h[:-width].copy()
        width *= 2
    hit = (W.mix(h[lo - first :]) & MASK) == 0
    after = data[lo + 1 : end + 1]
    hit[: len(after)] &= (after & 0xC0) != 0x80
    return np.flatnonzero(hit) + lo + 1


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def _texts(path: str, block: int, decode: bool = True):
    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            data, offs = W.buffers(batch.column(1))
            for a, z in W.blocks(offs, block):
                own, o = data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
                coded = e.block(own.tobytes(), cuts(own, o))
                at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                out = {"doc_id": batch.column(0).slice(a, z - a), "ids": lists} | ({"decoded": e.decoded(lists)} if decode else {})
                yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return run


def encoded(docs: DataFrame, path: str, block: int = W.BLOCK_BYTES, decode: bool = True) -> DataFrame:
    """doc_id, ids and, with ``decode``, decoded (the text that decoding the ids gives) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(_texts(path, block, decode), f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded`` from ``ids``: the pieces' strings joined as the tokenizer does."""

    @F.arrow_udf(returnType="string")
    def text(ids: pa.Array) -> pa.Array:
        t = encoder(path).tokenizer
        return pa.array([t.decode(x or [], skip_special_tokens=False) for x in ids.to_pylist()], pa.string())

    return rows.withColumn("decoded", text("ids"))
