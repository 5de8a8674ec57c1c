"""Bounded same-class search and sums against all pairs; far cells are not looked into."""

import numpy as np
import pytest

from stratum.operators.class_search import average_distance_bounded, nearest_same_class_bounded

SCHEMA = "index long, label int, features array<double>"


def points():
    """Three classes of tight clumps far apart, equal rows, a class of one row."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 8, (400, 1)) * 20.0 + rng.normal(size=(400, 3)) * 0.2
    x[:25] = 5.0
    labels = np.arange(400) % 3
    labels[399] = 9
    return x, labels


@pytest.fixture(scope="module")
def table(spark):
    x, labels = points()
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, labels, strict=True))], SCHEMA).repartition(4)


def test_nearest_by_all_pairs(table):
    x, labels = points()
    got = nearest_same_class_bounded(table, cells=8).collect()
    assert len(got) == 400
    for r in got:
        i = r["index"]
        others = np.flatnonzero((labels == labels[i]) & (np.arange(400) != i))
        if not len(others):
            assert r["distance"] is None
        else:
            assert r["distance"] == pytest.approx(np.sqrt(((x[others] - x[i]) ** 2).sum(axis=1)).min())
    # the clumps lie far apart: hardly any row looks beyond its own cell
    assert sum(r["probed"] for r in got) < 400 * 3


@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_average_within_tolerance(table, tolerance):
    x, labels = points()
    got = average_distance_bounded(table, tolerance, cells=8).collect()
    assert len(got) == 400
    for r in got:
        own = np.flatnonzero(labels == labels[r["index"]])
        if len(own) == 1:
            assert r["avg_distance"] is None
            continue
        want = np.sqrt(((x[own] - x[r["index"]]) ** 2).sum(axis=1)).sum() / (len(own) - 1)
        assert abs(r["avg_distance"] - want) <= tolerance * want + 1e-9
    if tolerance:
        assert sum(r["near_cells"] for r in got) < 400 * 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest_same_class_bounded(none).collect() == [] and average_distance_bounded(none).collect() == []
