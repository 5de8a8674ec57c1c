"""The experiment grid: every cell numbered, empty cells, options, the job from a file."""

import random

import pytest
from pyspark.sql import functions as F

from stratum.operators.metrics import METRIC_NAMES
from stratum.plans.experiment import run_experiment
from stratum.plans.job import fold_grader, run_job
from stratum.plans.vote_grid import vote_grid_metrics


def minority(spark, grades=(0, 1, 2, 3), n=60):
    rng = random.Random(2)
    rows = [(i, i % 3 if i % 4 else 0, rng.choice(grades), [rng.random() + i % 3, rng.random()]) for i in range(n)]
    return spark.createDataFrame(rows, "index long, label int, minority_type int, features array<double>")


def test_forest_cells_are_all_numbered(spark):
    """Only grade 0 occurs: subsets without it are empty cells and keep their numbers."""
    out = run_experiment(minority(spark, grades=(0,)), methods=("none", "smote"), num_splits=2, num_trees=2,
                         parallel_fits=4).collect()
    assert sorted((r["fold"], r["index"]) for r in out) == [(f, i) for f in range(2) for i in range(30)]
    for r in out:
        has = "0" in r["minority_types"]
        assert r["status"] == ("ok" if has else "empty_class") and r["n_test"] == 30
        assert (r["n_train"] is not None) == has
        assert all((r[m] is not None and 0 <= r[m] <= 1) if has else r[m] is None for m in METRIC_NAMES)


@pytest.mark.parametrize("pool", ["class", "selected"])
def test_smote_plus_cells(spark, pool):
    out = run_experiment(minority(spark), methods=("smotePlus",), subsets=[[0, 1, 2, 3], [3], [0, 1]], num_splits=2,
                         cluster_ks=(2, 40), cutoffs=(0.0, 0.9), num_trees=2, pool=pool, folds=[1]).collect()
    assert [r["index"] for r in out] == list(range(12))
    assert [(r["clusters"], r["cutoff"]) for r in out] == [(k, c) for k in (2, 40) for _ in range(3) for c in (0.0, 0.9)]
    assert {r["status"] for r in out if r["cutoff"] == 0.0 and r["minority_types"] == "[0 1 2 3]"} == {"ok"}


def test_pool_is_checked(spark):
    with pytest.raises(ValueError):
        run_experiment(minority(spark), pool="other")


def test_vote_grid_keeps_empty_cells(spark):
    out = vote_grid_metrics(minority(spark, grades=(1,)), methods=("none", "undersample"), num_splits=3).collect()
    assert sorted((r["fold"], r["index"]) for r in out) == [(f, i) for f in range(3) for i in range(30)]
    assert all((r["status"] == "ok") == ("1" in r["minority_types"]) for r in out)


def test_job_per_fold(spark, tmp_path):
    raw = minority(spark).select("index", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"), "label")
    raw.write.option("header", True).csv(str(tmp_path / "in"))
    out = run_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema=raw.schema, label_col="label",
                  index_col="index", methods=("none",), num_splits=2, per_fold=True)
    assert out.count() == 30 and out.where("status = 'ok'").count() > 0
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"fold=0", "fold=1"}


def test_fold_grader_uses_training_ranges(spark):
    raw = minority(spark).drop("minority_type")
    train, test = raw.where("index < 40"), raw.where("index >= 40").withColumn("features", F.array(F.lit(99.0), F.lit(-9.0)))
    tr, te = fold_grader(3)(train, test)
    assert tr.where(F.exists("features", lambda x: (x < 0) | (x > 1))).count() == 0
    assert te.where(F.exists("features", lambda x: (x < 0) | (x > 1))).count() == te.count()
