"""Grade subsets and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.exprs import subset_text


def subset_list() -> list[list[int]]:
    """the 15 non-empty subsets of grades {0,1,2,3} (a fixed order). Subset i keeps grade t when bit t
    of i is clear, so i=0 is [0 1 2 3] and i=14 is [0]."""
    return [[t for t in range(4) if not (i >> t) & 1] for i in range(15)]


def subsets_table(spark: SparkSession) -> DataFrame:
    """F1 as a 15-row config table ``subset_id int, types array<int>, subset string``."""
    base = spark.range(15).select(F.col("id").cast("int").alias("subset_id"))
    lists = F.array(*[F.array(*[F.lit(t) for t in sub]) for sub in subset_list()])
    types = F.element_at(lists, F.col("subset_id") + 1)
    return base.select("subset_id", types.alias("types")) \
        .withColumn("subset", subset_text("types"))


def filter_types(minority: DataFrame, types: Sequence[int]) -> DataFrame:
    """keep rows whose grade is in ``types`` (a plain ``IN`` predicate Catalyst can push)."""
    return minority.where(F.col("minority_type").isin([int(t) for t in types]))


def filter_all_subsets(minority: DataFrame) -> DataFrame:
    """F2 over the whole grid at once: every row paired with each of the 15 subsets that
    keeps its grade (``subset_id`` column). A row of grade g appears in 8 subsets; the
    expansion is an explode inside the map task, no join."""
    # subsets keeping grade g: ids whose bit g is clear
    per_grade = F.array(*[F.array(*[F.lit(i) for i in range(15) if not (i >> g) & 1])
                          for g in range(4)])
    keep = F.element_at(per_grade, F.col("minority_type") + 1)
    return minority.withColumn("subset_id", F.explode(keep))


def rows_of_class(df: DataFrame, label: int) -> DataFrame:
    """F3."""
    return df.where(F.col("label") == int(label))


def cluster_keep(clustered: DataFrame, types: Sequence[int], cutoff: float) -> DataFrame:
    """``label, cluster, n, n_selected, keep`` - a cluster is kept when the share of its
    rows whose grade is selected reaches ``cutoff`` (computed per cutoff, not accumulated)."""
    sel = F.col("minority_type").isin([int(t) for t in types])
    agg = clustered.groupBy("label", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sel).alias("n_selected"))
    return agg.withColumn("keep", F.col("n_selected") >= F.col("n") * F.lit(float(cutoff)))


def select_by_clusters(clustered: DataFrame, types: Sequence[int], cutoff: float) -> DataFrame:
    """rows of kept clusters whose grade is selected."""
    keep = cluster_keep(clustered, types, cutoff).where("keep").select("label", "cluster")
    return filter_types(clustered, types).join(keep, ["label", "cluster"], "left_semi")


def empty_classes(minority: DataFrame) -> DataFrame:
    """``subset_id, label, status``: the classes that a grade subset leaves without a row, for all
    subsets from one aggregate (the grades that a class has)."""
    present = minority.groupBy("label").agg(F.collect_set("minority_type").alias("present"))
    lists = F.array(*[F.array(*[F.lit(t) for t in sub]) for sub in subset_list()])
    each = present.select("label", "present", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("subset_id"))
    none = F.size(F.array_intersect("present", F.element_at(lists, F.col("subset_id") + 1))) == 0
    return each.where(none).select("subset_id", "label", F.lit("empty_class").alias("status"))
