"""Dense positions and folds: plain frames in fresh sessions, wide ids, groups, ties."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stratum.operators.common import dense_positions
from stratum.operators.prepare import string_index, with_row_index

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

FRESH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate())
from stratum.operators.common import dense_positions
from stratum.operators.folds import assign_folds
spark.sparkContext.setCheckpointDir({tmp!r})
n = {n}
df = spark.range(n).select((F.col("id") * 3).alias("index"), (F.col("id") % 3).cast("int").alias("label"))
if {kind!r} == "cached":
    df = df.cache()
elif {kind!r} == "parquet":
    df.write.parquet({tmp!r} + "/t")
    df = spark.read.parquet({tmp!r} + "/t")
else:
    df = df.checkpoint()
folds = {{r["fold"]: r["count"] for r in assign_folds(df, 5).groupBy("fold").count().collect()}}
assert folds == {{f: n // 5 for f in range(5)}}, folds
pos = dense_positions(df, "index", ["label"], size_col="n")
bad = pos.where((F.col("pos") != F.floor(F.col("index") / 9)) | (F.col("n") < n // 3)).count()
assert bad == 0 and pos.count() == n
print("FINE")
"""


@pytest.mark.parametrize("kind,n", [("cached", 5000), ("cached", 200000), ("parquet", 200000), ("checkpoint", 5000)])
def test_fresh_session(kind, n, tmp_path):
    code = FRESH.format(root=ROOT, tmp=str(tmp_path), n=n, kind=kind)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "FINE" in out.stdout, out.stderr[-2000:]


def test_wide_and_negative_ids(spark):
    rng = random.Random(1)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [0, -1, 1 << 40, (1 << 62) + 5, -(1 << 62)]
    rows = [(i, k % 2) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "index long, label int").repartition(5)
    got = {r["index"]: (r["pos"], r["n"]) for r in dense_positions(df, "index", ["label"], size_col="n").collect()}
    for lab in (0, 1):
        own = sorted(i for i, x in rows if x == lab)
        assert [got[i] for i in own] == [(p, len(own)) for p in range(len(own))]


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(50)], "index long, h long").repartition(3)
    got = [r["index"] for r in dense_positions(df, "h", tiebreak="index").orderBy("pos").collect()]
    assert got == sorted(range(50), key=lambda i: (i % 4, i))
    assert dense_positions(df.limit(0), "index").count() == 0


def test_row_index(spark):
    df = spark.range(1000).repartition(7)
    out = with_row_index(df)
    assert sorted(r["index"] for r in out.collect()) == list(range(1000))


def test_null_category_raises(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    with pytest.raises(Exception, match="NULL category"):
        string_index(df, ["c"]).collect()


def test_positions_have_no_lambda_or_driver_job(spark):
    df = spark.range(100).select(F.col("id").alias("index"))
    plan = dense_positions(df, "index")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
