"""Class counts, targets and vector means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame) -> DataFrame:
    """A1/A3: ``label, n`` (hash aggregate with a map-side partial step)."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_targets(counts: DataFrame) -> DataFrame:
    """A2: one row ``n_classes, min_n, max_n, under_target, over_target, smote_target``:
    undersample to the smallest class, oversample to the largest, SMOTE to half the largest
    (integer division)."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("min_n"), F.max("n").alias("max_n"),
    ).select("n_classes", "min_n", "max_n",
             F.col("min_n").alias("under_target"), F.col("max_n").alias("over_target"),
             F.floor(F.col("max_n") / 2).cast("long").alias("smote_target"))


def counts_with_targets(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., label, n, min_n, max_n``: per-class counts plus min/max over the classes
    of the same key, as window aggregates over the small count table (one row per key and
    class)."""
    from pyspark.sql import Window
    k = list(keys)
    c = df.groupBy(*k, "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    return c.select(*k, "label", "n", F.min("n").over(w).alias("min_n"),
                    F.max("n").over(w).alias("max_n"))


def mean_of_arrays(arrays: Column, width: Column | int | None = None) -> Column:
    """A4: feature-wise mean of an array of equal-length double arrays, summed in the array's
    order (sort the array first for a layout-independent result)."""
    first = F.element_at(arrays, 1)
    n = F.size(arrays)
    idx = F.sequence(F.lit(0), F.size(first) - 1)
    return F.transform(idx, lambda i: F.aggregate(arrays, F.lit(0.0),
                                                  lambda acc, a: acc + a[i]) / n)


def cluster_histogram(clustered: DataFrame) -> DataFrame:
    """``label, cluster, minority_type, n``."""
    return clustered.groupBy("label", "cluster", "minority_type") \
        .agg(F.count(F.lit(1)).alias("n"))


def feature_columns(df: DataFrame, width: int, col: str = "features", digits: int | None = 6,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Spread an array column into ``f0..f{width-1}`` (rounded), for reports and checks."""
    def f(i):
        c = F.col(col)[i]
        return (F.round(c, digits) if digits is not None else c).alias(f"f{i}")
    return df.select(*keep, *[f(i) for i in range(width)])
