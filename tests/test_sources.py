"""Saved tables with manifests, sorted files, rejected lines, medians, many dictionaries."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.prepare import dictionaries, impute_median, string_index
from stratum.plans.job import run_job
from stratum.sources.files import load_or_compute, read_with_rejects, write_sorted
from stratum.sources.manifest import NAME, StaleTable, made_from


def minority(spark, n=20):
    return spark.createDataFrame([(i, i % 2, i % 4, [float(i), 0.5]) for i in range(n)],
                                 "index long, label int, minority_type int, features array<double>")


def test_good_stale_and_partial_tables(spark, tmp_path):
    minority(spark).select("index").write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    saved, calls = f"{tmp_path}/saved", []

    def compute():
        calls.append(1)
        return minority(spark)

    origin = made_from(source, k=5, seed=1)
    with pytest.raises(StaleTable, match="no manifest"):
        load_or_compute(spark, "read", saved, compute, "parquet", origin)
    assert load_or_compute(spark, "write", saved, compute, "parquet", origin).count() == 20
    assert load_or_compute(spark, "read", saved, compute, "parquet", made_from(source, seed=1, k=5)).count() == 20
    assert len(calls) == 1
    with pytest.raises(StaleTable, match="parameters"):
        load_or_compute(spark, "read", saved, compute, "parquet", made_from(source, k=6, seed=1))
    part = next(f for f in sorted(os.listdir(saved)) if f.startswith("part-"))
    os.truncate(f"{saved}/{part}", 10)
    with pytest.raises(StaleTable, match="files"):
        load_or_compute(spark, "read", saved, compute, "parquet", origin)
    load_or_compute(spark, "write", saved, compute, "parquet", origin)  # written anew, whole again
    assert load_or_compute(spark, "read", saved, compute, "parquet", origin).count() == 20
    minority(spark, 3).select("index").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(StaleTable, match="inputs"):
        load_or_compute(spark, "read", saved, compute, "parquet", made_from(spark.read.parquet(f"{tmp_path}/in"), k=5, seed=1))
    os.remove(f"{saved}/{NAME}")
    with pytest.raises(StaleTable):
        load_or_compute(spark, "read", saved, compute, "parquet", origin)


def test_job_reads_what_it_wrote(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("index"), (F.col("id") % 7).cast("double").alias("a"),
                                  F.sin("id").alias("b"), (F.col("id") % 2).cast("int").alias("label"))
    rows.write.option("header", True).csv(f"{tmp_path}/in")
    args = dict(schema=rows.schema, label_col="label", index_col="index", model="vote", num_splits=2, methods=("none",),
                search="exact", minority=f"{tmp_path}/graded")
    first = run_job(spark, f"{tmp_path}/in", f"{tmp_path}/a", mode="write", **args).collect()
    again = run_job(spark, f"{tmp_path}/in", f"{tmp_path}/b", mode="read", **args).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    with pytest.raises(StaleTable):
        run_job(spark, f"{tmp_path}/in", f"{tmp_path}/c", mode="read", **{**args, "k": 3})


def test_sorted_files_are_disjoint(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("index"), F.lit("x").alias("v")).repartition(5)
    write_sorted(rows, f"{tmp_path}/s", files=6)
    back = spark.read.parquet(f"{tmp_path}/s")
    spans = back.groupBy(F.input_file_name()).agg(F.min("index").alias("lo"), F.max("index").alias("hi")).orderBy("lo").collect()
    assert len(spans) > 1 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:], strict=False))
    part = back.where("index between 500 and 700")
    assert "GreaterThanOrEqual(index,500)" in part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 201 and part.select(F.input_file_name()).distinct().count() < len(spans)


def test_rejects_and_medians(spark, tmp_path):
    lines = ["index,a,b", "1,2.5,x", "2,,y", "3,abc,z", "4,7.0", "5,1.0,w,extra", "six,1.0,v", "7,9.0,u", ""]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    kept, rejected = read_with_rejects(spark, f"{tmp_path}/f.csv", schema)
    assert sorted(r["record"] for r in rejected.collect()) == ["3,abc,z", "4,7.0", "5,1.0,w,extra", "six,1.0,v"]
    assert sorted((r["index"], r["a"]) for r in impute_median(kept, ["a"]).collect()) == [(1, 2.5), (2, 2.5), (7, 9.0)]
    nothing = spark.createDataFrame([(None,), (None,)], "a double")
    assert impute_median(nothing, ["a"]).where("a is null").count() == 2


def test_many_dictionaries(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("b", "y", 3), ("c", "y", 4), ("c", "q", 5)], "p string, q string, n int")
    got = {(r["column"], r["value"]): r["label"] for r in dictionaries(rows, ["p", "q"]).collect()}
    assert got == {("p", "b"): 0, ("p", "c"): 1, ("p", "a"): 2, ("q", "x"): 0, ("q", "y"): 1, ("q", "q"): 2}
    out = sorted(tuple(r) for r in string_index(rows, ["p", "q"]).collect())
    assert out == [(1, 0, 0), (2, 2, 0), (3, 0, 1), (4, 1, 1), (5, 1, 2)]
    with pytest.raises(Exception, match="NULL category"):
        string_index(spark.createDataFrame([("a",), (None,)], "p string"), ["p"]).collect()
