"""What the blocked kernels hold and compute: bounded by tiles, whatever the rows look like."""

import numpy as np
import pandas as pd

from stratum.operators import knn as K


def _block(x, ids):
    return (pd.DataFrame({"q_index": ids, "q_label": 0, "q_features": list(x)}),
            pd.DataFrame({"index": ids, "label": 0, "features": list(x), "draw": 0}))


def test_rows_at_one_place_are_not_compared_pair_by_pair(monkeypatch):
    seen, exact = [], K._exact_d2
    monkeypatch.setattr(K, "_exact_d2", lambda x, y, r, c: seen.append(len(r)) or exact(x, y, r, c))
    x = np.full((1500, 4), 0.25)
    got = K._block_topk(5, True)((0,), *_block(x, np.arange(1500)[::-1]))
    assert sum(seen) <= 6 * 1500
    got = got.sort_values(["index", "n_index"])
    assert got[got["index"] == 0]["n_index"].tolist() == [1, 2, 3, 4, 5]
    assert got[got["index"] == 1499]["n_index"].tolist() == [0, 1, 2, 3, 4] and (got["d2"] == 0).all()


def test_wide_and_crowded_rows_match_all_pairs():
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(700, 32)), 1e4 + 1e-3 * rng.normal(size=(700, 32)), 1e25 * rng.normal(size=(700, 32)),
              rng.integers(0, 2, (700, 16)).astype(float)):
        got = K._block_topk(4, True)((0,), *_block(x, np.arange(len(x))))
        every = np.zeros((len(x), len(x)))
        for j in range(x.shape[1]):
            every += (x[:, None, j] - x[None, :, j]) ** 2
        np.fill_diagonal(every, np.inf)
        want = np.argsort(every, axis=1, kind="stable")[:, :4]
        by = got.sort_values(["index", "d2", "n_index"])["n_index"].to_numpy().reshape(-1, 4)
        assert (by == want).all()


def test_kernel_tasks_grow_with_the_block_groups(spark):
    df = spark.range(1)
    few = K._kernel_partitions(df)
    assert K._kernel_partitions(df, 3) == min(3, few)
    assert K._kernel_partitions(df, 4000) == max(few, 1000)
