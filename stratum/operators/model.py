"""Models: MLlib random forest (L1) and the deterministic kNN-vote stand-in (L2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.box_search import knn_boxes
from stratum.operators.knn import DEFAULT_BLOCK_ROWS, _splits, blocked_neighbours, few_features
from stratum.operators.prepare import to_vector


def random_forest_predict(train: DataFrame, test: DataFrame, num_trees: int = 10,
                          seed: int = 42, num_classes: int | None = None) -> DataFrame:
    """L1: fit ``RandomForestClassifier`` (10 trees, seed 42) on ``train``, predict ``test``.
    Returns ``test`` columns plus ``prediction int``. ``num_classes`` (largest label + 1),
    where known, saves the job that looks for it."""
    from pyspark.ml.classification import RandomForestClassifier
    known = {"ml_attr": {"type": "nominal", "num_vals": int(num_classes)}} if num_classes else None
    tr = train.select(F.col("label").cast("double").alias("label", metadata=known) if known else
                      F.col("label").cast("double").alias("label"),
                      "features")
    tr, te = to_vector(tr, out="fv").drop("features"), to_vector(test, out="fv")
    rf = RandomForestClassifier(numTrees=num_trees, seed=seed, labelCol="label",
                                featuresCol="fv", predictionCol="prediction")
    model = rf.fit(tr)
    out = model.transform(te).drop("fv", "rawPrediction", "probability")
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def knn_vote_predict(train: DataFrame, test: DataFrame, k: int = 5,
                     cell_col: str | None = None) -> DataFrame:
    """L2 (a stand-in, not part of the workload): predict each test row as the majority
    label of its k nearest train rows, ties to the lower label. Deterministic, so the
    resample -> predict -> metrics path can be checked in SQL.

    With ``cell_col``, train and test rows carry a grid-cell id (int) and every test row is
    only compared with train rows of the same cell - one plan for a whole grid. At equal
    distance an original row comes before a synthetic one, then the smaller id, or for
    synthetic rows the smaller label and draw. Returns ``cell, index, label, prediction``.
    """
    cell = F.col(cell_col) if cell_col else F.lit(0)
    made = F.col("is_synthetic") if "is_synthetic" in train.columns else F.lit(False)
    draw = F.col("draw") if "draw" in train.columns else F.lit(0)
    d = train.select(F.when(made, F.col("label").cast("long")).otherwise(F.col("index")).alias("index"),
                     "label", "features", cell.alias("cell"),
                     F.when(made, draw).otherwise(F.lit(0)).cast("long").alias("draw"))
    q = test.select("index", "label", "features", F.array(cell).alias("probes"))
    # the cell is a key of the search, so one test row may take part in many cells
    nb = blocked_neighbours(q, d, k, exclude_self=False, min_split=1, per_cell=True)
    pred = _majority(nb, ["cell", "index", "label"])
    return pred.select("cell", "index", "label", "prediction")


def _majority(nb: DataFrame, by: list[str]) -> DataFrame:
    """``by, prediction``: the label of most neighbours, ties to the lower one."""
    return nb.groupBy(*by).agg(F.collect_list("n_label").alias("_l")).select(*by, majority("_l").alias("prediction"))


def majority(labels: Column | str) -> Column:
    """The most frequent value of a short array of whole numbers, ties to the lowest."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    votes = F.transform(F.array_distinct(labels), lambda v: F.struct(
        F.size(F.filter(labels, lambda x: x == v)).alias("n"), (-v).alias("low")))
    return -F.array_max(votes)["low"]


def fold_vote_predict(folded: DataFrame, k: int = 5) -> DataFrame:
    """L2 for all folds of ``index, label, features, fold`` in one search: every row against
    the rows of the other folds, its own fold passed over inside the kernel, so training rows
    are not copied for the folds they train. Returns ``fold, index, label, prediction``."""
    rows = folded.select("index", "label", "features", F.col("fold").alias("part"))
    n = rows.count()
    if few_features(rows, n):
        nb = knn_boxes(rows, k, skip_part=True)
    else:
        split = _splits(rows, n, DEFAULT_BLOCK_ROWS)
        nb = blocked_neighbours(rows.withColumn("probes", F.array(F.lit(0))), rows.withColumn("cell", F.lit(0)), k,
                                exclude_self=False, skip_part=True, fixed_splits=(split, split))
    pred = _majority(nb, ["index", "label"])
    return pred.join(folded.select("index", "fold"), "index").select("fold", "index", "label", "prediction")
