"""Large meetings of op8 hold a bounded number of points and pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.llm import jaccard as J


def meeting(n, groups, rng, one=True):
    """A table of n members with equal points: each pair is admitted."""
    fine = J.packed_point(rng.integers(0, 1 << 62, 400).astype(np.uint64), J.FINE).tobytes()
    label = np.arange(n) % groups if groups else np.where(np.arange(n) < 5, np.arange(n), 9)
    return pa.table({"tok": pa.array(np.full(n, 7) if one else np.arange(n) // 40), "sig": pa.array(rng.permutation(n).astype(np.int64)), "n": pa.array(np.full(n, 400)), "pos": pa.array(np.zeros(n, np.int64)), "fine": pa.array([fine] * n, pa.binary()), "label": pa.array(label.astype(np.int64))})


def pairs(t, top):
    return sorted({(a, b) for r in J._rest(0, t, 75, 100, top) for a, b in zip(*(x.to_pylist() for x in r.columns))})


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (20, 90):
        t = meeting(n, 7, rng)
        for top in (4, None):
            monkeypatch.setattr(J, "SLICE", 1 << 16)
            want = pairs(t, top)
            monkeypatch.setattr(J, "SLICE", 50)
            assert pairs(t, top) == want and want
        if n == 90:  # every pair of different components
            sig, lab = t.column("sig").to_pylist(), t.column("label").to_pylist()
            every = {tuple(sorted((sig[i], sig[j]), key=lambda x: x & (1 << 64) - 1)) for i in range(n) for j in range(i) if lab[i] != lab[j]}
            assert {tuple(sorted(((a ^ -(1 << 63)) , (b ^ -(1 << 63))))) for a, b in want} == {tuple(sorted(x)) for x in every}


def peak(make):
    tracemalloc.start()
    try:
        for _ in make():
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_large_meetings():
    rng = np.random.default_rng(2)
    # 3,000 members of two components: 2.25 million pairs, of which four stay
    wide = meeting(3000, 2, rng)
    assert peak(lambda: J._rest(0, wide, 75, 100, 4)) < 60e6
    # 20,000 members of 500 meetings: their points are not open at once
    many = meeting(20000, 40, rng, one=False)
    assert peak(lambda: J._rest(0, many, 75, 100, 4)) < 30e6
