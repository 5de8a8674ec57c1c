"""Keyed k-means by plain Lloyd rounds; SMOTE+ cells of the grid against a call for each cell."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators.clusters import keyed_clusters
from stratum.operators.resample import smote_plus, smote_plus_rows
from stratum.operators.subsets import cluster_keep, filter_types, select_by_clusters
from stratum.plans import experiment as X


def rows(n=120):
    rng = random.Random(6)
    return [(i, i % 3 if i % 5 else 0, rng.choice([0, 1, 2, 3]), i % 2, [rng.random() * 3 + i % 3, rng.random() * 2]) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "index long, label int, minority_type int, fold int, features array<double>").repartition(5)


def test_keyed_clusters_by_lloyd(spark, table):
    ks = (1, 2, 7, 60)
    order = {r["index"]: r["h"] for r in table.select("index", F.xxhash64(F.lit(1), "index").alias("h")).collect()}
    got = {}
    for r in keyed_clusters(table, ks, ["fold"], seed=1).collect():
        got.setdefault((r["fold"], r["label"], r["k"]), {})[r["index"]] = (r["cluster"], r["k_eff"])
    for fold in (0, 1):
        for label in (0, 1, 2):
            some = sorted((r for r in rows() if r[1] == label and r[3] == fold), key=lambda r: (order[r[0]], r[0]))
            x = np.array([r[4] for r in some])
            for k in ks:
                c = x[:k].copy()
                for _ in range(20):
                    own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                    new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
                    done, c = np.abs(new - c).max() <= 1e-4, new
                    if done:
                        break
                own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                assert got[fold, label, k] == {r[0]: (j, len(c)) for r, j in zip(some, own, strict=True)}
                assert len(c) == min(k, len(some))
    assert len(got) == 2 * 3 * len(ks)
    assert keyed_clusters(table.where("index < 0"), ks, ["fold"]).collect() == []


def plain(df, extra=()):
    return sorted(repr((*[r[c] for c in extra], r["label"], r["draw"], [round(v, 9) for v in r["features"]])) for r in df.collect())


def test_keyed_rows_equal_single_calls(spark, table):
    clustered = keyed_clusters(table, (2, 5), ["fold"]).persist()
    some = filter_types(clustered, [1, 2])
    both = smote_plus_rows(some, clustered, F.col("k"), keys=["fold", "k"])
    single = []
    for fold in (0, 1):
        for k in (2, 5):
            one = clustered.where((F.col("fold") == fold) & (F.col("k") == k))
            made = smote_plus_rows(filter_types(one, [1, 2]), one, k)
            single += plain(made.withColumn("fold", F.lit(fold)).withColumn("k", F.lit(k)), ("fold", "k"))
    assert plain(both, ("fold", "k")) == sorted(single) and single
    union = smote_plus(some, clustered, F.col("k"), keys=["fold", "k"])
    assert union.count() == some.count() + both.count()
    clustered.unpersist()


@pytest.mark.parametrize("pool", ["class", "selected"])
def test_cells_equal_single_calls(spark, table, pool):
    subsets, ks, cutoffs, folds = [[0, 1, 2, 3], [1, 3]], (2,), [0.0, 0.4], [1]
    train = table.withColumn("fold", 1 - F.col("fold"))
    tables, cell = X._plus_cells(train, folds, subsets, ks, cutoffs, pool, 42, 1)
    clustered = tables[0]
    seen = 0
    for fold in folds:
        for k in ks:
            one = clustered.where((F.col("fold") == fold) & (F.col("k") == k))
            for types in subsets:
                for cutoff in cutoffs:
                    chosen, extra, n = cell(fold, types, k, cutoff)
                    sel = select_by_clusters(one, types, cutoff)
                    classes = {r["label"] for r in sel.select("label").distinct().collect()}
                    assert (n is None) == (len(classes) < 3)
                    if n is None:
                        continue
                    want = smote_plus(sel, one if pool == "class" else sel, k)
                    originals = filter_types(one, types) if chosen is None else chosen
                    assert sorted(r[0] for r in originals.select("index").collect()) == sorted(r[0] for r in sel.select("index").collect())
                    assert plain(extra) == plain(want.where("is_synthetic")) and want.count() == n
                    assert cluster_keep(one, types, cutoff).where("keep").count() > 0
                    seen += 1
    assert seen >= 2
