"""Sums of distances are taken by tiles."""

import tracemalloc

import numpy as np

from stratum.operators import knn as K


def test_sums_of_distances_hold_a_tile():
    rng = np.random.default_rng(3)
    x, y = rng.random((2000, 4)), rng.random((12_000, 4))
    y[:500] = x[:500]
    tracemalloc.start()
    s = K._distance_sums(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # all pairs: 192 MB
    want = [np.sqrt(((y - row) ** 2).sum(axis=1)).sum() for row in x]
    assert np.allclose(s, want, rtol=1e-12)
    assert (K._distance_sums(np.full((9, 3), 0.3), np.full((7, 3), 0.3)) == 0).all()
    assert np.allclose(K._distance_sums(np.array([[1e170, 0.0]]), np.array([[0.0, 0.0]])), [np.inf])
