"""Minority-type grading: safe / borderline / rare / outlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import GRADE_NAMES, grade_expr
from stratum.operators.knn import knn
from stratum.session import reliable_checkpoint


def same_class_counts(neighbours: DataFrame) -> DataFrame:
    """``index, same, n_neighbours`` from the long neighbour table.

    Grouped by ``index`` only, so it reuses the hash partitioning of the top-k window.
    """
    return neighbours.groupBy("index").agg(
        F.sum((F.col("n_label") == F.col("label")).cast("int")).cast("int").alias("same"),
        F.count(F.lit(1)).cast("int").alias("n_neighbours"))


def grade_rows(points: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """M1+M3: ``index, label, minority_type, features``.

    A row with no neighbour at all (a one-row table) has 0 same-class neighbours: outlier.
    """
    same = same_class_counts(neighbours).select("index", "same")
    j = points.select("index", "label", "features").join(same, "index", "left")
    return j.select("index", "label",
                    grade_expr(F.coalesce(F.col("same"), F.lit(0)), k).alias("minority_type"),
                    "features")


def minority_types(points: DataFrame, k: int = 5, neighbours: DataFrame | None = None
                   ) -> DataFrame:
    """M3/M4/M5: grade every row of an indexed (already scaled) table by its k nearest
    neighbours. Exact neighbours unless a neighbour table is passed (e.g. cell-pruned)."""
    nb = neighbours if neighbours is not None else knn(points, k)
    return grade_rows(points, nb, k)


def type_report(minority: DataFrame) -> DataFrame:
    """M8: ``label, minority_type, n`` count per (class, grade) in one aggregate."""
    return minority.groupBy("label", "minority_type").agg(F.count(F.lit(1)).alias("n"))


def one_vs_rest(points: DataFrame, neighbours: DataFrame, classes: Sequence[int], k: int
                ) -> DataFrame:
    """M6: for every row and every class c, ``is_positive`` (row of class c) and the grade of
    the row in the binary problem "c vs rest": positives count neighbours of class c,
    negatives count neighbours not of class c.

    ``classes`` is the (small) list of class labels; each row is expanded once per class
    inside its map task, with no join.
    """
    nl = neighbours.groupBy("index").agg(F.collect_list("n_label").alias("nl"))
    rows = points.select("index", "label").join(nl, "index", "left") \
        .withColumn("nl", F.coalesce("nl", F.array().cast("array<int>")))
    x = rows.select("index", "label", "nl",
                    F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("cls"))
    pos = F.col("label") == F.col("cls")
    hits = F.when(pos, F.size(F.filter("nl", lambda v: v == F.col("cls")))) \
        .otherwise(F.size(F.filter("nl", lambda v: v != F.col("cls"))))
    return x.select("index", F.col("cls").alias("class"), pos.cast("int").alias("is_positive"),
                    grade_expr(hits, k).alias("minority_type"))


def one_vs_rest_report(ovr: DataFrame) -> DataFrame:
    """M7: per class and side (positive/negative): total rows and the count per grade."""
    return ovr.groupBy("class", "is_positive").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("minority_type") == code).alias(name)
          for code, name in enumerate(GRADE_NAMES)])


def one_vs_rest_totals(points: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """M7 from the neighbours alone: the same table as ``one_vs_rest_report(one_vs_rest(..))``
    without a row per row and class.

    To a row, a class other than its own that none of its neighbours has is plain: negative,
    with all neighbours as hits. Only the other classes, at most k + 1, are expanded; the plain
    rows of a class are what is left of all rows with the same number of neighbours.
    """
    nl = neighbours.groupBy("index").agg(F.collect_list("n_label").alias("nl"))  # k labels
    rows = points.select("index", "label").join(nl, "index", "left").select(
        "label", F.coalesce("nl", F.array().cast("array<int>")).alias("nl"))
    # read four times below: staged, so the neighbours are found once
    rows = reliable_checkpoint(rows.withColumn("tn", F.size("nl")))
    cls = F.explode(F.array_distinct(F.concat(F.array("label"), "nl")))
    own = F.col("class") == F.col("label")
    same = F.size(F.filter("nl", lambda v: v == F.col("class")))
    told = (rows.withColumn("class", cls)
            .select("class", own.cast("int").alias("is_positive"), "tn",
                    grade_expr(F.when(own, same).otherwise(F.col("tn") - same), k).alias("minority_type"))
            .groupBy("class", "is_positive", "tn", "minority_type").agg(F.count(F.lit(1)).alias("n")))
    by_tn = rows.groupBy("tn").agg(F.count(F.lit(1)).alias("n_all"))  # at most k + 1 rows
    expanded = told.groupBy("class", "tn").agg(F.sum("n").alias("n_told"))
    plain = (told.select("class").distinct()
             .withColumn("tn", F.explode(F.sequence(F.lit(0), F.lit(k)))).join(by_tn, "tn")
             .join(expanded, ["class", "tn"], "left")
             .select("class", F.lit(0).alias("is_positive"), "tn", grade_expr(F.col("tn"), k).alias("minority_type"),
                     (F.col("n_all") - F.coalesce("n_told", F.lit(0))).alias("n")).where("n > 0"))
    return told.unionByName(plain).groupBy("class", "is_positive").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("minority_type") == code, F.col("n")).otherwise(0)).alias(name)
          for code, name in enumerate(GRADE_NAMES)])


def class_list(df: DataFrame, label_col: str = "label") -> list[int]:
    """Distinct class labels (a short list: one entry per class)."""
    return sorted(r[0] for r in df.select(label_col).distinct().collect())
