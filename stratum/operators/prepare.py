"""Preparation: indexed tables, scaling, label dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.common import dense_positions, global_rank, join_small


def _checked(c: Column, what: str) -> Column:
    """Fail the job (JVM-side, lazily) on a NULL instead of silently dropping the row."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"NULL {what}"))).otherwise(c)


def with_row_index(df: DataFrame, index_col: str = "index") -> DataFrame:
    """Dense 0-based row index in scan order (the zipWithIndex of the reference).

    ``monotonically_increasing_id`` follows scan order but has gaps; ranking it with
    :func:`dense_positions` closes them without sorting everything in one task. The ids are
    written with a reliable checkpoint first, so a recomputed task (lost executor) cannot
    renumber rows.
    """
    from stratum.session import reliable_checkpoint
    tmp = reliable_checkpoint(df.withColumn("_mid", F.monotonically_increasing_id()))
    return dense_positions(tmp, "_mid", pos_col=index_col).drop("_mid")


def to_indexed(df: DataFrame, label_col: str, feature_cols: Sequence[str] | None = None,
               index_col: str | None = None) -> DataFrame:
    """P1+P3: ``(index long, label int, features array<double>)``.

    The label is chosen by name (the reference silently took the last column). Features
    keep their column order. A non-integral label or a NULL fails the job.
    """
    if feature_cols is None:
        feature_cols = [c for c in df.columns if c not in (label_col, index_col)]
    if index_col is None:
        df = with_row_index(df, "_index")
        index_col = "_index"
    lab = F.col(label_col).cast("double")
    label = F.when(lab != F.floor(lab), F.raise_error(F.lit("non-integral label"))) \
        .otherwise(lab.cast("int"))
    feats = F.array(*[_checked(F.col(c).cast("double"), f"feature {c}") for c in feature_cols])
    return df.select(F.col(index_col).cast("long").alias("index"),
                     _checked(label, "label").alias("label"),
                     feats.alias("features"))


def parse_features_text(df: DataFrame, col: str = "features") -> DataFrame:
    """``"[a,b,c]"`` text to array<double>, JVM-side."""
    parsed = F.transform(F.split(F.regexp_replace(F.col(col), r"[\[\]\s]", ""), ","),
                         lambda x: x.cast("double"))
    return df.withColumn(col, parsed)


def features_text(df: DataFrame, col: str = "features") -> DataFrame:
    """S3: array<double> to ``"[a,b,c]"`` text."""
    txt = F.concat(F.lit("["), F.array_join(F.transform(F.col(col), lambda x: x.cast("string")),
                                            ","), F.lit("]"))
    return df.withColumn(col, txt)


def to_vector(df: DataFrame, col: str = "features", out: str | None = None) -> DataFrame:
    """P5: array<double> to an MLlib dense vector (only at MLlib edges)."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out or col, array_to_vector(F.col(col)))


def feature_ranges(df: DataFrame, col: str = "features", with_count: bool = False):
    """Per-position min and max of an array column in one pass.

    MLlib's ``Summarizer`` keeps two vectors and a count for each partition and merges them
    element by element, so a partition sends one row whatever the number of features. The
    result is one row, the only thing collected. With ``with_count`` the number of rows is
    returned as well. Rows without features are passed over; arrays must have one length.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    vectors = df.where(F.size(F.col(col)) > 0).select(array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    # grouped by a constant, so that a table without rows gives no row
    found = vectors.groupBy(F.lit("all")).agg(Summarizer.metrics("min", "max", "count").summary(F.col("v")).alias("s")) \
        .select("s.*").collect()
    mins, maxs, n = (list(found[0]["min"]), list(found[0]["max"]), found[0]["count"]) if found else ([], [], 0)
    return (mins, maxs, n) if with_count else (mins, maxs)


def min_max_scale(df: DataFrame, col: str = "features",
                  ranges: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Scale every feature to [0, 1] with (x - min) / (max - min); constant feature -> 0.5.

    Matches MLlib ``MinMaxScaler`` defaults. The fitted ranges can be passed in (e.g. fit on
    train, apply to test).
    """
    mins, maxs = ranges or feature_ranges(df, col)
    if not mins:
        return df
    mn = F.array(*[F.lit(float(v)) for v in mins])
    mx = F.array(*[F.lit(float(v)) for v in maxs])

    def scale(x, i):
        lo, hi = mn[i], mx[i]
        return F.when(hi == lo, F.lit(0.5)).otherwise((x - lo) / (hi - lo))

    return df.withColumn(col, F.transform(F.col(col), scale))


def string_index(df: DataFrame, cols: Sequence[str], suffix: str = "_idx",
                 drop: bool = True) -> DataFrame:
    """Replace string columns by their frequency-ranked index (StringIndexer order:
    most frequent first, ties alphabetical), named ``<col>_idx``.

    All columns' values are counted in one scan and ranked together (:func:`dictionaries`).
    A dictionary is broadcast where it is short enough, by the counts of distinct values
    that come with the ranking. A NULL category fails the job.
    """
    found = dictionaries(df, cols)
    sizes = {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        d = found.where(F.col("column") == c).select(F.col("value").alias(c), F.col("label").alias(c + suffix))
        out = join_small(out.withColumn(c, _checked(F.col(c), f"category {c}")), d, c, "left", known_rows=sizes.get(c, 0))
        if drop:
            out = out.drop(c)
    return out


def dictionaries(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P7/P8 for many string columns: ``column, value, label``, each column in StringIndexer order.

    One scan turns the columns into (column, value) and counts; one distributed ranking
    orders the values of all columns, and a column's labels start where its values do."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _rank(counts, [F.asc("column"), F.desc("_n"), F.asc("value")])
    starts = ranked.groupBy("column").agg(F.min("_r").alias("_first"))  # a row per column
    return ranked.join(F.broadcast(starts), "column").select("column", "value", (F.col("_r") - F.col("_first")).cast("int").alias("label"))


def impute_median(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """§1.2: NULL numbers of ``cols`` replaced by the column's median, an explicit option.

    The medians come from one pass of mergeable quantile sketches (their rank error is
    1 / ``accuracy``); a column of NULLs alone stays as it is."""
    medians = df.agg(*[F.percentile_approx(c, F.lit(0.5), accuracy).alias(c) for c in cols]).first()
    return df.fillna({c: medians[c] for c in cols if medians[c] is not None})


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """``(label int, value string)`` table, one row per distinct value, StringIndexer order."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("value").isNotNull())
    ranked = _rank(counts, [F.desc("_n"), F.asc("value")])
    return ranked.select(F.col("_r").cast("int").alias("label"), "value")


def alphabetical_dictionary(df: DataFrame, col: str) -> DataFrame:
    """Dense rank of the distinct values of ``col`` in ascending order, 0-based."""
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranked = _rank(vals, [F.asc("value")])
    return ranked.select(F.col("_r").cast("int").alias("label"), "value")


def _rank(values: DataFrame, order) -> DataFrame:
    """``_r`` = 0-based position in ``order``, by the distributed :func:`global_rank`."""
    return global_rank(values, order, "_r")


def label_names(df: DataFrame, dictionary_df: DataFrame, label_col: str = "label",
                name_col: str = "name") -> DataFrame:
    """Attach the original name of each label via the dictionary (distinct pairs
    of ``label``/``value``)."""
    return df.join(dictionary_df.select(F.col("label").alias(label_col),
                                        F.col("value").alias(name_col)),
                   on=label_col, how="left")


def greater(a: Column | str, b: Column | str) -> Column:
    """P10: scalar max of two values."""
    return F.greatest(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
