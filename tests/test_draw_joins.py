"""Draws grow with the rows: they are not broadcast, and cells of a grid are not drawn in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratum.operators import resample as R
from stratum.plans import vote_grid as V


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    some = [(i, 0 if i % 9 else 1 + i % 2, i % 4, i % 5, i % 3, [rng.random(), rng.random()]) for i in range(180)]
    ddl = "index long, label int, minority_type int, fold int, cluster int, features array<double>"
    return spark.createDataFrame(some, ddl).cache()


def broadcast_draws(df):
    """The broadcasts of the plan that hold what draws were exploded into."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:|+-]*(\*\(\d+\) )?", line)[0]) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                below.append(lines[j])
            found += [x for x in below if re.search(r"Generate explode\(sequence\(\(\(?_ch", x)]
    return found


@pytest.mark.parametrize("make", [
    lambda r: R.oversample(r, keys=["fold"]), lambda r: R.smote_rows(r, keys=["fold"]), lambda r: R.smote_plus_rows(r, r, 3, keys=["fold"])])
def test_resampling_broadcasts_no_draws(rows, make):
    df = make(rows)
    assert "_ch" in df._jdf.queryExecution().executedPlan().toString()
    assert not broadcast_draws(df)


def test_vote_grid_broadcasts_no_draws(rows):
    counts = V.reliable_checkpoint(V.training_counts(rows, 5))
    ids = rows.select("index", "label", "minority_type", "fold")
    numbered = V.reliable_checkpoint(V._numbered(ids, counts.where("n < max_n"), 5), cache=False)
    for df in (V.copy_counts(numbered, counts, 42), V.synthetic_rows(numbered, rows, counts, 42)):
        assert df.count() and not broadcast_draws(df)


def test_cells_are_drawn_apart(spark):
    need = spark.createDataFrame([(f, s, 1, 7, 50) for f in range(5) for s in range(15)], "fold int, subset_id int, label int, n int, m long")
    by_task = R.draw_table(need).groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 1 and max(r["count"] for r in by_task) < 75 * 50 / 2
