"""Neighbour search: ids of any size, refused features, complete and pruned searches."""

import random

import pytest
from pyspark.sql import functions as F

from stratum.operators import knn as K
from stratum.operators.model import knn_vote_predict

SCHEMA = "index long, label int, features array<double>"


def cloud(n, seed, spread=1.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = rng.randrange(6)
        out.append((i, c % 3, [c * 4 + rng.gauss(0, spread), c * 3 + rng.gauss(0, spread), rng.gauss(0, spread)]))
    return out


def table(df):
    return sorted((r["index"], r["rn"], r["n_index"]) for r in df.collect())


def test_vote_keeps_large_and_negative_ids(spark):
    train = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [10.0])], SCHEMA)
    ids = [(1 << 40) + 5, -3, 1 << 41, (1 << 62) + 1]
    test = spark.createDataFrame([(i, 0, [0.1 if k % 2 else 9.9]) for k, i in enumerate(ids)], SCHEMA)
    got = {r["index"]: (r["cell"], r["prediction"]) for r in knn_vote_predict(train, test, k=1).collect()}
    assert got == {i: (0, 0 if k % 2 else 1) for k, i in enumerate(ids)}


def test_vote_per_cell_and_ties(spark):
    """One test row in two cells; at equal distance originals precede synthetic rows."""
    train = spark.createDataFrame(
        [(5, 2, [1.0], False, None, 0), (None, 1, [1.0], True, 1, 0), (None, 0, [1.0], True, 2, 1), (None, 3, [2.0], True, 1, 1)],
        "index long, label int, features array<double>, is_synthetic boolean, draw long, cell int")
    test = spark.createDataFrame([(7, 0, [0.0], 0), (7, 0, [0.0], 1)], SCHEMA + ", cell int")
    got = {r["cell"]: r["prediction"] for r in knn_vote_predict(train, test, k=1, cell_col="cell").collect()}
    assert got == {0: 2, 1: 0}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_features_that_are_not_finite_fail(spark, bad):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [2.0, bad]), (2, 1, [0.0, 1.0])], SCHEMA)
    with pytest.raises(Exception, match="NULL, NaN or infinite|float"):
        K.knn(df, 1).collect()


def test_far_points_are_neighbours(spark):
    """A distance that overflows is still a distance: only the row itself is left out."""
    df = spark.createDataFrame([(0, 0, [-1e200]), (1, 0, [1e200])], SCHEMA)
    assert table(K.knn(df, 1)) == [(0, 1, 1), (1, 1, 0)]


def test_cells_always_return_k(spark):
    rows = cloud(120, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    approx = K.knn_cells(df, 7, n_cells=30, nprobe=1).cache()
    per_row = approx.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("m"))
    assert per_row.count() == 120 and per_row.where("n <> 7 or m <> 7").count() == 0
    exact = K.knn(df, 7)
    near = exact.select("index", "rn", F.col("d2").alias("best"))
    assert approx.join(near, ["index", "rn"]).where("d2 < best - 1e-9").count() == 0
    few = K.knn_cells(spark.createDataFrame(rows[:4], SCHEMA), 9, n_cells=3, nprobe=1)
    assert few.count() == 12  # all there are


@pytest.mark.parametrize("k,cells,spread", [(1, 5, 0.5), (5, 12, 1.0), (5, 12, 8.0), (40, 9, 1.0)])
def test_pruned_search_is_exact(spark, k, cells, spread):
    df = spark.createDataFrame(cloud(150, 11, spread), SCHEMA).repartition(3)
    assert table(K.knn_pruned(df, k, cells)) == table(K.knn(df, k))


def test_recall_of_probed_cells(spark):
    df = spark.createDataFrame(cloud(300, 5), SCHEMA)
    got = K.recall(K.knn_cells(df, 5, n_cells=10, nprobe=4), K.knn(df, 5)).first()["recall"]
    assert got >= 0.9


def test_one_vs_rest_totals_match_the_dense_form(spark):
    from stratum.operators import grading as G
    df = spark.createDataFrame([(i, lab if i % 9 else 7, f) for i, lab, f in cloud(90, 4, 3.0)], SCHEMA)
    nb = K.knn(df, 5)
    dense = G.one_vs_rest_report(G.one_vs_rest(df, nb, G.class_list(df), 5))
    key = ("class", "is_positive", "n", "safe", "borderline", "rare", "outlier")
    assert sorted(map(tuple, dense.select(*key).collect())) == \
        sorted(map(tuple, G.one_vs_rest_totals(df, nb, 5).select(*key).collect()))
