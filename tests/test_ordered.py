import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.streaming import ordered


def frames(rows, size):
    return (rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size))


@pytest.mark.parametrize("seed", range(6))
def test_runs_on_files_give_the_same_rows_as_one_sort(monkeypatch, seed):
    """Runs of some rows over several levels; null, NaN and equal keys; two order columns."""
    for name, value in (("RUN_BYTES", 3000), ("FAN_IN", 3), ("PIECES", 4), ("ROWS", 7)):
        monkeypatch.setattr(ordered, name, value)
    rng = random.Random(seed)
    n = rng.choice([1, 40, 300])
    rows = pd.DataFrame({"k": [rng.choice([None, "b", "é", "a", f"{rng.random()}"]) for _ in range(n)], "x": [rng.choice([float("nan"), -1.0, float(rng.randint(0, 9))]) for _ in range(n)], "seq": rng.sample(range(n), n), "t": pd.to_datetime([rng.randint(0, 10**9) for _ in range(n)], unit="s")})
    for order in (["seq"], ["x", "seq"], ["k", "x", "seq"], ["t", "seq"]):
        got = list(ordered.in_order(frames(rows, 11), order))
        assert all(0 < len(f) <= 7 for f in got)
        pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), rows.sort_values(order, ignore_index=True))


def test_memory_does_not_grow_with_the_rows(monkeypatch):
    monkeypatch.setattr(ordered, "RUN_BYTES", 2 << 20)

    def made(n):
        for i in range(0, n, 5000):
            seq = (np.arange(i, i + 5000) * 7919) % n
            yield pd.DataFrame({"seq": seq, "x": seq * 1.0, "y": seq * 2.0})

    peaks = []
    for n in (200_000, 1_000_000):  # 5 and 24 MB
        tracemalloc.start()
        at = 0
        for f in ordered.in_order(made(n), ["seq"]):
            assert f["seq"].iloc[0] == at and f["seq"].iloc[-1] == at + len(f) - 1
            at += len(f)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert at == n
    assert peaks[1] < 10 << 20 and peaks[1] < 2 * peaks[0] + (1 << 20)
