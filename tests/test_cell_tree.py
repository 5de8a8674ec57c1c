"""Two-level cells: every row is placed, recall is reached, odd tables do not break it."""

import numpy as np
import pytest

from stratum.operators import knn as K
from stratum.operators.cell_tree import fit_tree, knn_tree, probe_cells, probing_depth

SCHEMA = "index long, label int, features array<double>"


@pytest.fixture(scope="module")
def points(spark):
    """A third of the rows in one tight clump, some equal rows, the rest in ten loose ones."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) * 0.3 + rng.integers(0, 10, (900, 1)) * 3.0
    x[:300] = rng.normal(size=(300, 6)) * 0.01 + 50
    x[300:330] = 7.0
    return spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(5)


def test_rows_lie_in_the_nearest_cell_of_their_group(points):
    tree = fit_tree(points, 30)
    assert tree.rows.count() == 900 and tree.n_cells <= 4 * 30
    centres = {r["cell"]: np.array(r["centre"]) for r in tree.leaves.collect()}
    for r in tree.rows.collect():
        x, group = np.array(r["features"]), r["cell"] // tree.stride
        assert np.argmin(((tree.groups - x) ** 2).sum(axis=1)) == group
        own = {c: ((v - x) ** 2).sum() for c, v in centres.items() if c // tree.stride == group}
        assert own[r["cell"]] <= min(own.values()) + 1e-9


def test_probes_are_the_nearest_cells(points):
    tree = fit_tree(points, 30)
    centres = {r["cell"]: np.array(r["centre"]) for r in tree.leaves.collect()}
    for r in probe_cells(tree, points.limit(40), 2, 5).collect():
        x = np.array(r["features"])
        near = set(np.argsort(((tree.groups - x) ** 2).sum(axis=1), kind="stable")[:2])
        d = sorted(((v - x) ** 2).sum() for c, v in centres.items() if c // tree.stride in near)
        assert [((centres[c] - x) ** 2).sum() for c in r["probes"]] == pytest.approx(d[:5])


@pytest.mark.parametrize("recall", [0.6, 0.9])
def test_measured_recall_is_reached(points, recall):
    tree = fit_tree(points, 30)
    depth = probing_depth(tree, 5, recall, sample_rows=900)  # all rows: the measure is exact
    got = knn_tree(points, 5, 30, tree=tree, depth=depth)
    r = K.recall(got, K.knn(points, 5)).first()
    assert r["pairs"] == 4500 and r["recall"] >= recall
    assert got.where("rn = 5").count() == 900


def test_full_depth_is_exact(points):
    tree = fit_tree(points, 30)
    got = knn_tree(points, 5, 30, tree=tree, depth=(len(tree.groups), tree.n_cells))
    cols = ["index", "rn", "n_index", "d2"]
    assert got.select(cols).exceptAll(K.knn(points, 5).select(cols)).isEmpty()


def test_odd_tables(spark):
    assert knn_tree(spark.createDataFrame([], SCHEMA), 5, 8).collect() == []
    one = spark.createDataFrame([(1, 0, [1.0])], SCHEMA)
    assert knn_tree(one, 5, 8).collect() == []
    same = spark.createDataFrame([(i, 0, [2.0, 2.0]) for i in range(40)], SCHEMA)
    got = knn_tree(same, 3, 8)
    assert got.count() == 120 and got.where("d2 <> 0").count() == 0
    # a query beside the data finds k rows, itself among them
    assert knn_tree(same, 3, 8, query=same.limit(2)).count() == 6
