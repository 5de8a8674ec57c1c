"""Cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.common import dense_positions


def fold_expr(pos: str, n: str, num_splits: int = 5):
    """V1: contiguous folds over the dense position: cut_i = (n div s) * i, the last fold
    takes the remainder; with one split a 20 % holdout (fold 0 = first 20 %)."""
    p, total = F.col(pos), F.col(n)
    if num_splits < 2:
        cut = F.floor(total * 0.2)
        return F.when(p < cut, F.lit(0)).otherwise(F.lit(1))
    size = F.floor(total / num_splits)
    return F.when(size == 0, F.lit(num_splits - 1)) \
        .otherwise(F.least(F.floor(p / F.greatest(size, F.lit(1))), F.lit(num_splits - 1))) \
        .cast("int")


def assign_folds(df: DataFrame, num_splits: int = 5, order_col: str = "index") -> DataFrame:
    """V1: add ``fold`` from the rank of ``order_col`` (dense, no single-task sort)."""
    numbered = dense_positions(df, order_col, pos_col="_pos", size_col="_n")
    return numbered.withColumn("fold", fold_expr("_pos", "_n", num_splits)).drop("_pos", "_n")


def fold_split(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """V2: (train, test) for one fold, plain column filters."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
