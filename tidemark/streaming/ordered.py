"""Rows of one instrument in order, in bounded memory.

Spark hands a stateful function the rows of a group as frames in no order, and no sort is allowed before it on a stream.
So rows are sorted here: by runs of some megabytes, which go to files of the task's local folder where there is more
than one, and by merging these files piece by piece. Runs are merged by levels, so few are open at a time.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd

RUN_BYTES = 32 << 20
#: a run's file is read by so many pieces
PIECES = 64
FAN_IN = 32
#: rows of a frame given out, at most
ROWS = 10_000


class _Head:
    """The piece of a run that is read, and how far."""

    def __init__(self, pieces: Iterator[pd.DataFrame], order: Sequence[str]):
        self.pieces, self.order, self.frame, self.at = pieces, order, None, 0
        self.next()

    def next(self) -> None:
        self.frame, self.at = next(self.pieces, None), 0
        if self.frame is not None:
            self.columns = [(self.frame[c].isna().to_numpy(), self.frame[c].to_numpy()) for c in self.order]

    def key(self, i: int) -> tuple:
        """Invalid values come last, as in pandas' sort."""
        return tuple((True, 0) if none[i] else (False, x[i]) for none, x in self.columns)

    def until(self, bound: tuple) -> pd.DataFrame:
        end = bisect_right(range(len(self.frame)), bound, lo=self.at, key=self.key)
        out, self.at = self.frame.iloc[self.at : end], end
        return out


def _sorted(frames: Sequence[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return (frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)).sort_values(list(order), kind="stable", ignore_index=True)


def _merged(runs: Sequence[str], order: Sequence[str]) -> Iterator[pd.DataFrame]:
    """All rows up to the least last key of the pieces at hand, again and again."""
    heads = [h for h in (_Head(_read(r), order) for r in runs) if h.frame is not None]
    while heads:
        bound = min(h.key(len(h.frame) - 1) for h in heads)
        yield _sorted([h.until(bound) for h in heads], order)
        for h in heads:
            if h.at == len(h.frame):
                h.next()
        heads = [h for h in heads if h.frame is not None]


def _cut(frame: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for i in range(0, len(frame), rows):
        yield frame.iloc[i : i + rows]


def _write(frames: Iterable[pd.DataFrame], folder: str) -> str:
    handle, path = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as f:
        for frame in frames:
            pickle.dump(frame, f, pickle.HIGHEST_PROTOCOL)
    return path


def _read(path: str) -> Iterator[pd.DataFrame]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _local_dir() -> str | None:
    """Spark's folder for spilled rows, where it names one."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def in_order(frames: Iterable[pd.DataFrame], order_by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of all frames by ``order_by``, as frames of ``ROWS`` rows at most."""
    order, held, size = list(order_by), [], 0
    with tempfile.TemporaryDirectory(dir=_local_dir()) as folder:
        levels: list[list[str]] = [[]]
        for frame in frames:
            held.append(frame)
            size += int(frame.memory_usage(index=False, deep=True).sum())
            if size < RUN_BYTES:
                continue
            run = _sorted(held, order)
            levels[0].append(_write(_cut(run, -(-len(run) // PIECES)), folder))
            held, size, run, k = [], 0, None, 0
            while len(levels[k]) == FAN_IN:
                if k + 1 == len(levels):
                    levels.append([])
                pieces = (p for f in _merged(levels[k], order) for p in _cut(f, -(-len(f) // FAN_IN)))  # noqa: B023, used at once
                levels[k + 1].append(_write(pieces, folder))
                for path in levels[k]:
                    os.remove(path)
                levels[k], k = [], k + 1
        if held:
            last = _sorted(held, order)
            if levels == [[]]:
                yield from _cut(last, ROWS)
                return
            levels[0].append(_write(_cut(last, -(-len(last) // PIECES)), folder))
        held = last = None
        for f in _merged([path for level in reversed(levels) for path in level], order):
            yield from _cut(f, ROWS)
