"""Confusion tables and the ten multi-class metrics.

Orientation is standard (rows actual, columns predicted; fn from the row, fp from the
column). Classes are every label seen as actual or predicted; macro averages run over the
classes that have test rows; 0/0 counts as 0. All work happens on the small long confusion
table ``keys..., label, prediction, n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.prepare import greater

# The ten metric names, in the order of the result table.
METRIC_NAMES = ("AvAvg", "MAvG", "RecM", "PrecM", "Recu", "Precu", "FbM", "Fbu", "AvFb", "CBA")


def _div(a: Column, b: Column) -> Column:
    """a / b with 0/0 (or x/0) as 0 instead of an ANSI error."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(predictions: DataFrame, keys: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """A5 long form: ``keys..., label, prediction, n``."""
    return predictions.groupBy(*keys, F.col(label).cast("int").alias("label"),
                               F.col(prediction).cast("int").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(conf: DataFrame, labels: Sequence[int]) -> DataFrame:
    """A5 wide form: one row per actual label, one count column per predicted label in
    ``labels`` (explicit pivot values, so no extra job), NULL -> 0, ordered by label."""
    vals = [int(v) for v in labels]
    return conf.groupBy("label").pivot("prediction", vals).agg(F.sum("n")) \
        .na.fill(0).orderBy("label")


def class_rates(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., label, tp, fn, fp, tn, has_test`` per class."""
    k = list(keys)
    from pyspark.sql import Window
    # one pass over the confusion table: every cell adds to its actual class's row sum (and
    # tp on the diagonal) and to its predicted class's column sum
    side = F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("r"), F.lit(0).cast("long").alias("k"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n"))
                 .otherwise(F.lit(0)).cast("long").alias("t")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("r"),
                 F.col("n").alias("k"), F.lit(0).cast("long").alias("t"))))
    x = conf.select(*k, side.alias("_s")).select(*k, "_s.*")
    j = x.groupBy(*k, F.col("c").alias("label")).agg(
        F.sum("r").alias("row_n"), F.sum("k").alias("col_n"), F.sum("t").alias("tp"))
    # total per key as a window over the small per-class table (no one-row join)
    wk = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    j = j.withColumn("total", F.sum("row_n").over(wk))
    return j.select(*k, "label",
                    F.col("tp").cast("long").alias("tp"),
                    (F.col("row_n") - F.col("tp")).cast("long").alias("fn"),
                    (F.col("col_n") - F.col("tp")).cast("long").alias("fp"),
                    (F.col("total") - F.col("row_n") - F.col("col_n") + F.col("tp"))
                    .cast("long").alias("tn"),
                    (F.col("row_n") > 0).alias("has_test"))


def _fbeta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return _div(F.lit(1 + b2) * p * r, F.lit(b2) * p + r)


def metrics(rates: DataFrame, keys: Sequence[str] = (), beta: float = 0.5) -> DataFrame:
    """E2-E11 per key: AvAvg, MAvG, RecM, PrecM, Recu, Precu, FbM, Fbu, AvFb, CBA and
    ``n_classes_scored``."""
    k = list(keys)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    per = rates.select(
        *k, "has_test", tp.alias("tp"), fn.alias("fn"), fp.alias("fp"),
        _div(tp + tn, tp + tn + fp + fn).alias("acc"),
        _div(tp, tp + fn).alias("rec"), _div(tp, tp + fp).alias("prec"),
        _div(tp, greater(tp + fn, tp + fp)).alias("cba"))
    per = per.withColumn("fb", _fbeta(F.col("prec"), F.col("rec"), beta))
    t = F.col("has_test")

    def mavg(c):
        return F.avg(F.when(t, F.col(c)))

    agg = per.groupBy(*k).agg(
        mavg("acc").alias("AvAvg"),
        F.min(F.when(t, F.col("rec"))).alias("_minrec"),
        F.avg(F.when(t & (F.col("rec") > 0), F.ln(F.col("rec")))).alias("_lnrec"),
        mavg("rec").alias("RecM"), mavg("prec").alias("PrecM"),
        F.sum("tp").alias("_tp"), F.sum(F.col("tp") + F.col("fn")).alias("_t"),
        F.sum(F.col("tp") + F.col("fp")).alias("_p"),
        mavg("fb").alias("AvFb"), mavg("cba").alias("CBA"),
        F.count_if(t).alias("n_classes_scored"))
    recu = _div(F.col("_tp"), F.col("_t"))
    precu = _div(F.col("_tp"), F.col("_p"))
    return agg.select(
        *k, "AvAvg",
        F.when(F.col("_minrec") > 0, F.exp(F.col("_lnrec"))).otherwise(F.lit(0.0)).alias("MAvG"),
        "RecM", "PrecM", recu.alias("Recu"), precu.alias("Precu"),
        _fbeta(F.col("PrecM"), F.col("RecM"), beta).alias("FbM"),
        _fbeta(precu, recu, beta).alias("Fbu"),
        "AvFb", "CBA", F.col("n_classes_scored").cast("long").alias("n_classes_scored"))


def evaluate(predictions: DataFrame, keys: Sequence[str] = (), beta: float = 0.5) -> DataFrame:
    """Predictions -> confusion -> rates -> metrics."""
    return metrics(class_rates(confusion(predictions, keys), keys), keys, beta)
