"""Resampling invariants: exact targets, determinism across layouts, synthetic bounds."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import resample as R
from stratum.operators.aggregates import class_counts, mean_of_arrays


def data(spark, parts=None):
    rows = [(i, 0 if i < 40 else (1 if i < 50 else 2), [float(i), float(i % 7)], i % 4)
            for i in range(57)]
    df = spark.createDataFrame(rows, "index long, label int, features array<double>, "
                                     "minority_type int")
    return df.repartition(parts) if parts else df


def counts(df):
    return {r.label: r.n for r in class_counts(df).collect()}


def test_targets(spark):
    df = data(spark)
    assert counts(R.undersample(df)) == {0: 7, 1: 7, 2: 7}
    assert counts(R.oversample(df)) == {0: 40, 1: 40, 2: 40}
    assert counts(R.smote(df)) == {0: 40, 1: 20, 2: 20}
    assert counts(R.resample(df, "none")) == {0: 40, 1: 10, 2: 7}
    with pytest.raises(ValueError):
        R.resample(df, "bogus")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_layout_independent(spark, parts):
    base = sorted(tuple(r) for r in R.smote_rows(data(spark)).select(
        "label", "draw", "features").collect())
    other = sorted(tuple(r) for r in R.smote_rows(data(spark, parts)).select(
        "label", "draw", "features").collect())
    assert base == other
    sel = ["index", F.coalesce("draw", F.lit(-1)).alias("draw")]
    ov = sorted(tuple(r) for r in R.oversample(data(spark, parts)).select(*sel).collect())
    ov1 = sorted(tuple(r) for r in R.oversample(data(spark)).select(*sel).collect())
    assert ov == ov1


def test_synthetic_within_class_range(spark):
    df = data(spark)
    syn = R.smote_rows(df)
    rng = df.groupBy("label").agg(F.min(F.col("features")[0]).alias("lo"),
                                  F.max(F.col("features")[0]).alias("hi"))
    bad = syn.join(rng, "label").where((F.col("features")[0] < F.col("lo")) |
                                       (F.col("features")[0] > F.col("hi")))
    assert bad.count() == 0
    assert syn.where(F.col("index").isNotNull() | (F.col("minority_type") != -1)).count() == 0


def test_keyed_equals_standalone(spark):
    df = data(spark)
    keyed = df.withColumn("k", F.lit(5)).unionByName(df.withColumn("k", F.lit(9)))
    a = sorted(tuple(r) for r in R.smote_rows(keyed, keys=["k"]).where("k = 9")
               .select("label", "draw", "features").collect())
    b = sorted(tuple(r) for r in R.smote_rows(df).select("label", "draw", "features").collect())
    assert a == b


def test_mean_of_draws(spark):
    # draws hit rows 2 and 5 (twice / three times): SMOTE+ weighs 2/5 and 3/5
    df = spark.createDataFrame([([[1.0], [1.0], [6.0], [6.0], [6.0]],)], "a array<array<double>>")
    assert df.select(mean_of_arrays(F.col("a"))).first()[0] == [4.0]


def test_salting_does_not_change_draws(spark, monkeypatch):
    df = data(spark)

    def snap():
        ov = sorted(tuple(r) for r in R.oversample(df).select(
            "label", F.coalesce("index", F.lit(-1)), F.coalesce("draw", F.lit(-1))).collect())
        sm = sorted(tuple(r) for r in R.smote_rows(df).select("label", "draw", "features")
                    .collect())
        pool = df.withColumn("cluster", F.pmod("index", F.lit(3)))
        sp = sorted(tuple(r) for r in R.smote_plus_rows(df, pool, 3).select(
            "label", "draw", "features").collect())
        return ov, sm, sp

    base = snap()
    monkeypatch.setattr(R, "SALT_TARGET", 1)  # every class replicated: many salts per key
    assert snap() == base
