"""Per-class resampling, one plan for all classes.

Draws are ``md5(seed:label:draw[:j]) mod n`` (see :func:`draw_position`): stateless,
reproducible, independent of partitioning and task order. Positions within a class come
from :func:`dense_positions`, which never sorts a whole class in one task. Draw tables are
generated in chunks, so a class needing a billion new rows is still spread over many
tasks.

Every method takes ``keys``: extra grouping columns (e.g. fold and grade subset of an
experiment grid). Each key is resampled on its own - targets, positions and draws per
key - so a whole grid is one plan, and each cell gets exactly the rows a standalone call
on that cell would give (the key is not part of the draw hash).

Output schema of every method (``resampled``), after the key columns::

    index long (NULL for synthetic rows), label int, minority_type int (-1 synthetic),
    features array<double>, is_synthetic boolean, draw long (NULL for original rows)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.exprs import DRAW_DIGITS, draw_position, hash_number
from stratum.operators.aggregates import counts_with_targets, mean_of_arrays
from stratum.operators.common import BROADCAST_MAX_ROWS, default_buckets, dense_positions, join_rows, join_small
from stratum.operators.subsets import filter_types
from stratum.session import reliable_checkpoint

METHODS = ("none", "undersample", "oversample", "smote")
#: Undersampling counts hashes of 60 bits by their first 12: 4,096 buckets for each class.
HASH_BITS, CUT_BITS = 4 * DRAW_DIGITS, 12
DRAW_CHUNK = 100_000
# Draws per (class, position) join key before the class's rows are replicated (salted).
SALT_TARGET = 10_000


def _salt_factor(n: Column, draws: Column) -> Column:
    """Replication factor of a class so each (class, position, salt) key receives about
    ``SALT_TARGET`` draws at most: a tiny class drawn from very often is a hot key."""
    r = F.ceil(draws.cast("double") / (n.cast("double") * F.lit(SALT_TARGET)))
    return F.greatest(F.lit(1), r).cast("int")


def _staged_counts(df: DataFrame, keys) -> DataFrame:
    """Class counts and targets, written out: a row per key and class that a plan reads several
    times, and each reading would carry the whole plan of ``df`` once more."""
    return reliable_checkpoint(counts_with_targets(df, keys), cache=False)


def _in_need(df: DataFrame, need: DataFrame, keys) -> DataFrame:
    """The rows of the classes that get new rows, with their salt factor ``_r``.

    ``need`` has one row per class and key. Joined first, it keeps the classes that get
    nothing (the largest among them) out of the position and draw shuffles; the small side
    goes through the checked broadcast, so the large classes are not shuffled for it."""
    return join_small(df, need.select(*keys, "_r"), list(keys))


def _salted(numbered: DataFrame, keys) -> DataFrame:
    """``numbered`` rows, each replicated ``_r`` times with ``_salt`` 0.._r-1."""
    return numbered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).drop("_r")


def _original(df: DataFrame, keys=()) -> DataFrame:
    mt = F.col("minority_type") if "minority_type" in df.columns else F.lit(-1)
    return df.select(*keys, F.col("index").cast("long"), F.col("label").cast("int"),
                     mt.cast("int").alias("minority_type"), "features",
                     F.lit(False).alias("is_synthetic"), F.lit(None).cast("long").alias("draw"))


def draw_table(need: DataFrame, count_col: str = "m", chunk: int = DRAW_CHUNK) -> DataFrame:
    """Rows ``(<need columns>, s)`` with ``s = 1..m`` per row of ``need``.

    First explode into chunks of ``chunk`` draws (m/chunk rows), spread those over the
    cluster, then explode each chunk. All columns of ``need`` tell chunks apart, so the cells
    of a grid do not meet in the task of their label.
    """
    m = F.col(count_col).cast("long")
    nchunks = F.floor((m + F.lit(chunk - 1)) / F.lit(chunk)).cast("long")
    ch = need.where(m > 0).withColumn("_ch", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                  nchunks - 1)))
    ch = ch.repartition(default_buckets(need), *need.columns, "_ch")
    lo = F.col("_ch") * F.lit(chunk) + 1
    hi = F.least((F.col("_ch") + 1) * F.lit(chunk), m)
    return ch.withColumn("s", F.explode(F.sequence(lo, hi))).drop("_ch")


# ----------------------------------------------------------------- R1 undersample

def _hash_cuts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where undersampling cuts every class: ``keys, label, cut, rest``. Of rows with hash bucket
    below ``cut`` all stay, of those in it the first ``rest``.

    An exact count by hash bucket, so a class of any size is cut without being sorted; only
    its one bucket at the cut is. The table has a row per key and class; where that is
    within the broadcast bound it is fetched and handed out as a local table."""
    by = [*keys, "label"]
    buckets = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select(*by, "_b", "c", F.sum("c").over(up_to).alias("up"),
                             F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    least = F.min("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    cuts = buckets.withColumn("min_n", least).where((F.col("up") >= F.col("min_n")) & (F.col("up") - F.col("c") < F.col("min_n"))) \
        .select(*by, F.col("_b").alias("cut"), (F.col("min_n") - F.col("up") + F.col("c")).alias("rest"))
    few = cuts.limit(BROADCAST_MAX_ROWS + 1).collect()
    return cuts if len(few) > BROADCAST_MAX_ROWS else rows.sparkSession.createDataFrame(few, cuts.schema)


def undersample(df: DataFrame, seed: int = 42, keys=()) -> DataFrame:
    """Every class cut to exactly the smallest class size, keeping the rows with the
    smallest ``md5(seed:index)`` (ties by index). Exact size, seeded.

    One job counts the rows by class and hash bucket; then one scan keeps what lies below
    the cut and ranks only the bucket at it. Kept rows are shuffled once, spread evenly."""
    k = list(keys)
    h = hash_number(F.concat_ws(":", F.lit(str(seed)), F.col("index").cast("string")))
    bucket = F.shiftright("_h", HASH_BITS - CUT_BITS).cast("int")
    cuts = _hash_cuts(df.select(*k, "label", h.alias("_h")).withColumn("_b", bucket), k)
    near = df.withColumn("_h", h).withColumn("_b", bucket).join(cuts, [*k, "label"]).where("_b <= cut")
    # rows below the cut need no rank: they are only dealt out
    part = F.when(F.col("_b") == F.col("cut"), F.lit(-1)).otherwise(F.col("_b"))
    rank = F.row_number().over(Window.partitionBy(*k, "label", "_part").orderBy("_h", "index"))
    kept = near.withColumn("_part", part).withColumn("_rn", rank).where("_part >= 0 or _rn <= rest")
    return _original(kept, k)


# ----------------------------------------------------------------- R2 oversample

def oversample(df: DataFrame, seed: int = 42, keys=()) -> DataFrame:
    """R2: every non-empty class below the largest gets ``max - n`` copies of its own rows,
    copy s taking class position ``md5(seed:label:s) mod n``. Exact size, seeded."""
    k = list(keys)
    c = _staged_counts(df, k)
    need = c.where((F.col("n") > 0) & (F.col("n") < F.col("max_n"))) \
        .select(*k, "label", "n", (F.col("max_n") - F.col("n")).alias("m"))
    need = need.withColumn("_r", _salt_factor(F.col("n"), F.col("m")))
    draws = draw_table(need).withColumn("pos", draw_position(F.col("n"), seed, "label", "s")) \
        .withColumn("_salt", F.pmod(F.col("s"), F.col("_r")).cast("int"))
    numbered = _salted(dense_positions(_in_need(df, need, [*k, "label"]), "index", [*k, "label"]),
                       [*k, "label"])
    copies = join_rows(draws.select(*k, "label", "pos", "s", "_salt"), numbered, [*k, "label", "pos", "_salt"])
    mt = F.col("minority_type") if "minority_type" in df.columns else F.lit(-1)
    added = copies.select(*k, F.col("index").cast("long"), F.col("label").cast("int"),
                          mt.cast("int").alias("minority_type"), "features",
                          F.lit(False).alias("is_synthetic"), F.col("s").alias("draw"))
    return _original(df, k).unionByName(added)


# ----------------------------------------------------------------- R3/R4 SMOTE (mean form)

def smote_rows(df: DataFrame, seed: int = 42, draws_per_row: int = 5, keys=()) -> DataFrame:
    """R3 synthetic rows only: classes below half the largest class get ``max//2 - n`` new
    rows; row s is the mean of the *distinct* class rows hit by ``draws_per_row`` draws
    ``md5(seed:label:s:j) mod n``."""
    k = list(keys)
    c = _staged_counts(df, k)
    target = F.floor(F.col("max_n") / 2)
    need = c.where(F.col("n") < target).select(*k, "label", "n",
                                               (target - F.col("n")).alias("m"))
    need = need.withColumn("_r", _salt_factor(F.col("n"), F.col("m") * draws_per_row))
    draws = draw_table(need)
    dj = draws.select(*k, "label", "n", "s", "_r",
                      F.explode(F.sequence(F.lit(1), F.lit(draws_per_row))).alias("j"))
    dj = dj.select(*k, "label", "s",
                   draw_position(F.col("n"), seed, "label", "s", "j").alias("pos"),
                   F.pmod(F.col("s"), F.col("_r")).cast("int").alias("_salt"))
    numbered = _salted(dense_positions(
        _in_need(df.select(*k, "index", "label", "features"), need, [*k, "label"]), "index",
        [*k, "label"]), [*k, "label"])
    hit = join_rows(dj, numbered, [*k, "label", "pos", "_salt"])
    grp = hit.groupBy(*k, "label", "s").agg(
        F.array_distinct(F.array_sort(F.collect_list(F.struct("pos", "features")))).alias("_h"))
    mean = mean_of_arrays(F.transform("_h", lambda x: x["features"]))
    return grp.select(*k, F.lit(None).cast("long").alias("index"), F.col("label").cast("int"),
                      F.lit(-1).alias("minority_type"), mean.alias("features"),
                      F.lit(True).alias("is_synthetic"), F.col("s").cast("long").alias("draw"))


def smote(df: DataFrame, seed: int = 42, draws_per_row: int = 5, keys=()) -> DataFrame:
    """Original rows plus :func:`smote_rows`."""
    return _original(df, keys).unionByName(smote_rows(df, seed, draws_per_row, keys))


# ----------------------------------------------------------------- R5 SMOTE+ (cluster form)

def smote_plus_rows(selected: DataFrame | None, pool: DataFrame, draws_per_row: int | Column,
                    seed: int = 42, keys=(), need: DataFrame | None = None) -> DataFrame:
    """R5 synthetic rows. Targets come from ``selected`` (after grade/cluster filters):
    classes below half the largest get ``max//2 - n`` rows. Row s picks one of its class's
    clusters uniformly (``md5(seed:label:s)``), then averages ``draws_per_row`` draws with
    replacement from that cluster of ``pool`` (``md5(seed:label:s:j)``); duplicates count
    as often as drawn.

    ``pool``: ``keys, label, cluster, index, features`` (the whole class by default). Each key
    is resampled on its own, all in one plan; ``draws_per_row`` may be an expression of the
    keys. ``need`` (``keys, label, m``: new rows of a class) replaces ``selected`` where the
    caller knows the targets; it has a row per key and class.
    """
    k = list(keys)
    by = [*k, "label"]
    if need is None:
        c = _staged_counts(selected, k)
        target = F.floor(F.col("max_n") / 2)
        need = c.where(F.col("n") < target).select(*by, (target - F.col("n")).alias("m"))
    per_row = F.lit(draws_per_row) if isinstance(draws_per_row, int) else draws_per_row
    sizes = pool.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("size"))
    # one row per (key, class, cluster): bounded by the grid, the classes and k; written out, as
    # the draws meet it and the pool's rows do
    ranks = sizes.select(
        *by, "cluster", "size",
        (F.dense_rank().over(Window.partitionBy(*by).orderBy("cluster")) - 1).alias("crank"),
        F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("ncl"))
    # salt per (class, cluster): expected draws into a cluster ~ m * draws / ncl
    ranks = reliable_checkpoint(ranks.join(need, by).withColumn(
        "_r", _salt_factor(F.col("size"), F.col("m") * per_row / F.col("ncl"))), cache=False)
    # a draw becomes several rows below: smaller chunks
    draws = draw_table(ranks.select(*by, "m", "ncl").distinct(), chunk=DRAW_CHUNK // 10)
    picks = join_small(draws.withColumn("crank", draw_position(F.col("ncl"), seed, "label", "s")),
                       ranks.select(*by, "cluster", "size", "crank", "_r"), [*by, "crank"])
    dj = picks.select(*by, "cluster", "size", "s", "_r",
                      F.explode(F.sequence(F.lit(1), per_row)).alias("j"))
    dj = dj.select(
        *by, "cluster", "s", "j",
        draw_position(F.col("size"), seed, "label", "s", "j").alias("pos"),
        F.pmod(F.col("s"), F.col("_r")).cast("int").alias("_salt"))
    numbered = _salted(dense_positions(
        _in_need(pool.select(*by, "cluster", "index", "features"), ranks, [*by, "cluster"]),
        "index", [*by, "cluster"]), [*by, "cluster"])
    hit = join_rows(dj, numbered, [*by, "cluster", "pos", "_salt"])
    grp = hit.groupBy(*by, "s").agg(
        F.array_sort(F.collect_list(F.struct("j", "features"))).alias("_h"))
    mean = mean_of_arrays(F.transform("_h", lambda x: x["features"]))
    return grp.select(*k, F.lit(None).cast("long").alias("index"), F.col("label").cast("int"),
                      F.lit(-1).alias("minority_type"), mean.alias("features"),
                      F.lit(True).alias("is_synthetic"), F.col("s").cast("long").alias("draw"))


def smote_plus(selected: DataFrame, pool: DataFrame, draws_per_row: int | Column,
               seed: int = 42, keys=()) -> DataFrame:
    """Selected rows plus :func:`smote_plus_rows`, all classes (and keys) in one plan."""
    return _original(selected, keys).unionByName(smote_plus_rows(selected, pool, draws_per_row, seed, keys))


# ----------------------------------------------------------------- dispatch

def resample(df: DataFrame, method: str, seed: int = 42, keys=()) -> DataFrame:
    """One method over all classes (and keys); unknown names are rejected."""
    if method == "none":
        return _original(df, keys)
    if method == "undersample":
        return undersample(df, seed, keys)
    if method == "oversample":
        return oversample(df, seed, keys)
    if method == "smote":
        return smote(df, seed, keys=keys)
    raise ValueError(f"unknown sampling method {method!r}; use one of {METHODS} or smotePlus")


def resample_types(minority: DataFrame, types, method: str, seed: int = 42,
                   keys=()) -> DataFrame:
    """Keep the selected grades, then resample; targets are computed after the filter."""
    return resample(filter_types(minority, types), method, seed, keys)
