"""Search through boxes: the all-pairs answer, with ties, crowded places and one-sided parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import box_search as B
from stratum.operators import knn as K
from stratum.operators.model import fold_vote_predict
from stratum.plans import vote_grid as V

SCHEMA = "index long, label int, features array<double>, part int"


def brute(rows, k, parts=False):
    x = np.array([f for _, _, f, _ in rows])
    out = {}
    for i, (index, _, f, part) in enumerate(rows):
        d2 = ((x - np.array(f)) ** 2).sum(axis=1)
        order = sorted((float(d2[j]), r[0]) for j, r in enumerate(rows) if (r[3] != part if parts else j != i))
        out[index] = [n for _, n in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["index"], r["rn"])):
        out.setdefault(r["index"], []).append(r["n_index"])
    return out


def crowd(n, seed):
    """Whole numbers with many ties; a fourth of the rows stand at one place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        f = [3.0, 3.0, 0.0] if i % 4 == 0 else [float(rng.randrange(9)), float(rng.randrange(4)), float(rng.randrange(2))]
        rows.append((i * 3 - 50, i % 3, f, i % 5))
    return rows


@pytest.mark.parametrize("k", [1, 5])
def test_boxes_give_the_all_pairs_answer(spark, k):
    rows = crowd(400, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(B.knn_boxes(df, k, box_rows=20)) == brute(rows, k)


def test_boxes_on_a_spread_cloud(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(0, 1), rng.gauss(0, 5), rng.random(), 1.0], 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(B.knn_boxes(df, 5, box_rows=25)) == brute(rows, 5)


def test_boxes_where_parts_stand_apart(spark):
    """A box holds rows of one part alone, so its queries must look far."""
    rng = random.Random(4)
    rows = [(i, i % 2, [i // 100 * 50.0 + rng.randrange(6), float(rng.randrange(6))], i // 100) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(B.knn_boxes(df, 4, skip_part=True, box_rows=15)) == brute(rows, 4, parts=True)


def test_few_rows(spark):
    rows = crowd(3, 1)
    assert found(B.knn_boxes(spark.createDataFrame(rows, SCHEMA), 5, box_rows=1)) == brute(rows, 5)


def test_large_narrow_tables_go_through_boxes(spark, monkeypatch):
    """No block of the search holds more than a few boxes, whatever the table's rows."""
    rows = crowd(300, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    plain, votes = found(K.knn(df, 5)), fold_vote_predict(df.withColumnRenamed("part", "fold"), 5).collect()
    graded = df.withColumnRenamed("part", "fold").withColumn("minority_type", F.col("label"))
    lists = V.grade_lists(graded, 5).collect()
    monkeypatch.setattr(K, "BOX_MIN_ROWS", 100)
    calls = []
    real = B.box_neighbours
    monkeypatch.setattr(B, "box_neighbours", lambda *a, **kw: calls.append(1) or real(*a, **(kw | {"box_rows": 20})))
    assert found(K.knn(df, 5)) == plain == brute(rows, 5)
    assert sorted(fold_vote_predict(df.withColumnRenamed("part", "fold"), 5).collect()) == sorted(votes)
    assert sorted(V.grade_lists(graded, 5).collect()) == sorted(lists)
    assert len(calls) == 6  # four grades


@pytest.mark.parametrize("width,n", [(2, 700), (64, 900)])
def test_kernel_estimates_lose_no_neighbour(width, n):
    """Pairs kept by the estimated distances hold the exact k nearest, also far from the origin."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(n, width)) * 1e-3 + 1e4
    x[5:40] = x[4]
    none = (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
    d2 = np.zeros((n, n))
    for j in range(width):
        d2 += (x[:, j, None] - x[None, :, j]) ** 2
    kept = {}
    for r, c, dv in K._near_pairs(x, x, 4, lambda i, j: none):
        assert (d2[r, c] == dv).all()
        for a, b in zip(r, c, strict=True):
            kept.setdefault(int(a), set()).add(int(b))
    for i in range(n):
        assert set(np.lexsort((np.arange(n), d2[i]))[:4].tolist()) <= kept[i]
