"""Grids keep small plans: what each of hundreds of jobs carries is held by the driver."""

import random

import pytest

from stratum.plans import experiment as E
from stratum.plans.queries import QUERIES
from stratum.plans.vote_grid import vote_grid_metrics

SF001 = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def minority(spark):
    rng = random.Random(5)
    rows = [(i, 0 if i % 7 else 1 + i % 2, i % 4, [rng.random(), rng.random()]) for i in range(140)]
    return spark.createDataFrame(rows, "index long, label int, minority_type int, features array<double>").cache()


def test_grid_counts_plan(spark):
    assert plan(QUERIES["grid_counts"](spark, SF001)).count("Exchange") <= 4


def test_vote_grid_plan(minority):
    assert plan(vote_grid_metrics(minority, k=3)).count("Exchange") <= 12


def test_forest_fits_start_from_a_scan(spark, minority, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_fit_confusion", lambda train, *a: seen.append(plan(train)) or [])
    E.run_experiment(minority, methods=("oversample",), subsets=[[0, 1, 2, 3]], num_splits=2)
    assert seen and all(p.count("Exchange") == 0 for p in seen)


def test_forest_predictions_take_few_tasks(spark, minority, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_fit_confusion", lambda train, test, *a: seen.append((test.rdd.getNumPartitions(), test.count())) or [])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        E.run_experiment(minority, methods=("none",), subsets=[[0, 1, 2, 3]], num_splits=2)
    finally:
        spark.conf.set(coalesce, old)
    assert seen == [(1, 70), (1, 70)]


def test_forest_grid_collects_garbage(minority, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_fit_confusion", lambda *a: seen.append("fit") or [])
    monkeypatch.setattr(E, "collect_garbage", lambda spark: seen.append("collected"))
    monkeypatch.setattr(E, "FITS_KEPT", 2)
    E.run_experiment(minority, methods=("none",), subsets=[[0, 1, 2, 3], [0], [1]], num_splits=2, parallel_fits=1)
    assert seen == ["fit", "collected", "fit", "fit", "collected"] * 2
