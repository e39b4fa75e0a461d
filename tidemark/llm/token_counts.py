"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character;
dynamic programming carries the best score up to there and the number of pieces on that path, and
nothing else: no lattice, no pieces. Ties follow the tokenizer: a later path replaces an earlier one
only if its score is strictly greater, and paths arrive by their last piece's start, so of equal paths
the one with the longest last piece stays. A character that no single-character piece matches may be
unknown (least score of the vocabulary less 10); with byte pieces it counts its UTF-8 bytes, else a run
of unknown characters counts one.

White space of the one kind U+0020 starts a word (shown as U+2581, one before the text); no piece
crosses words, so equal words are scored once and kept in a store of bounded size, very long ones aside.

The vocabulary is that of a public file. Where the file has ranks instead of log probabilities (a BPE file), Zipf's law
gives these: a piece of rank r has a chance in proportion to 1 / (r + 1). Control pieces match nothing.

Edge cases: a null or empty text has no tokens; a text without spaces is one word, in time and memory
linear in its length; null ids, repeated rows and further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_LESS = 10.0
KEEP = 300_000
LONG = 64  # characters of a word that is kept

_state: dict = {}


class Counter:
    """``pieces`` and their ``scores``; byte pieces ``<0x..>`` are used for unknown characters if all are there."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.automaton = ahocorasick.Automaton()
        for p, s in zip(pieces, scores, strict=True):
            if p:
                self.automaton.add_word(p, (len(p), float(s)))
        self.automaton.make_automaton()
        self.bytes = all(f"<0x{i:02X}>" in self.automaton for i in range(256))
        self.unknown = min(scores) - UNKNOWN_LESS
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, count, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found, at = self.automaton.iter(word), 0
        hit = next(found, None)
        for at in range(n):
            top, pieces, single = None, 0, False
            while hit is not None and hit[0] == at:
                size, score = hit[1]
                start = at + 1 - size
                x = score + best[start]
                if top is None or x > top:
                    top, pieces = x, count[start] + 1
                if size == 1:
                    single = True
                hit = next(found, None)
            if not single:
                x = self.unknown + best[at]
                if top is None or x > top:
                    top = x
                    pieces = count[at] + (len(word[at].encode("utf-8", "surrogatepass")) if self.bytes else 0 if last[at] else 1)
                    last[at + 1] = True
            best[at + 1], count[at + 1] = top, pieces
        return count[n]

    def texts(self, texts: list[str]) -> list[int]:
        split = []
        for t in texts:
            parts = t.replace(SPACE, " ").split(" ")
            split.append(parts[1:] if not parts[0] else parts)
        known = {}
        for w in set().union(*split):
            n = self.new.get(w)
            if n is None:
                n = self.old.get(w)
                if n is None:
                    n = self.word(SPACE + w)
                if len(self.new) >= KEEP:
                    self.old, self.new = self.new, {}
                if len(w) <= LONG:
                    self.new[w] = n
            known[w] = n
        return [sum(map(known.__getitem__, parts)) for parts in split]


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and log probabilities of a sentencepiece file, the unknown piece first, control pieces left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unused(i))]
    scores = [float(m.get_score(i)) for i in some]
    if min(scores) < -1000:  # ranks
        rank = {i: r for r, i in enumerate(sorted((i for i in some if not (m.is_byte(i) or m.is_unknown(i))), key=lambda i: -m.get_score(i)))}
        scores = [-math.log(rank.get(i, len(rank)) + 1) for i in some]
    return [m.id_to_piece(i) for i in some], scores


def counter(path: str) -> Counter:
    if path not in _state:
        _state[path] = Counter(*vocabulary(path))
    return _state[path]


def counted(docs: DataFrame, path: str, block: int = 512) -> DataFrame:
    """doc_id and n_tokens of every row, by the unigram vocabulary at ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = []
            for i in range(0, batch.num_rows, block):
                n += c.texts([t or "" for t in batch.column(1).slice(i, block).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
