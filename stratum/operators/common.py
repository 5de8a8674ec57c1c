"""Shared building blocks: size-checked broadcast and dense row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest row count we hint as a broadcast side; beyond it the join shuffles.
BROADCAST_MAX_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast only when its row count is proven <= ``max_rows``.

    ``known_rows`` is a bound the caller can prove from parameters (e.g. the number of
    k-means cells); otherwise the small side is counted (one cheap job). Above the bound
    the join is left to Catalyst/AQE (sort-merge or shuffled hash).
    """
    n = known_rows if known_rows is not None else small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on=on, how=how)


def join_rows(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the rows, never broadcast.

    Spark takes the size of an exploded table for that of the rows it was exploded from, so
    draws made from a table of class counts look like a few KB; adaptive execution sees
    better but keeps a planned broadcast, since the merge costs it an exchange more."""
    return left.hint("merge").join(right, on, how)


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


#: Levels of ``dense_positions``: a leaf spans 2^16 values of the order column, a branch 2^40.
LEAF_BITS, BRANCH_BITS = 16, 40


def dense_positions(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (),
                    pos_col: str = "pos", size_col: str | None = None,
                    tiebreak: str | None = None) -> DataFrame:
    """Add ``pos`` = 0-based rank of ``(order_col, tiebreak)`` within ``partition_cols``.

    ``order_col`` must hold integers; with ``tiebreak`` the pair must be unique within a
    group, without it ``order_col`` must be. The group columns and the order must not be
    NULL. Optional ``size_col`` carries the group's total row count.

    The order's values are cut into leaves and branches of a fixed span, by bit shifts. Rows
    are counted by leaf, counts are summed up before each leaf of a branch and before each
    branch, and a row's position is what stands before its leaf plus its row number in the
    leaf. A leaf holds at most 2^16 different values and a branch 2^24 leaves, so no task
    sorts a group (a class may hold a third of the rows). No job runs while the plan is built.
    """
    parts = list(partition_cols)
    order = F.col(order_col).cast("long")
    b = df.withColumns({"_leaf": F.shiftright(order, LEAF_BITS),
                        "_branch": F.shiftright(order, BRANCH_BITS)})
    leaves = b.groupBy(*parts, "_branch", "_leaf").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    in_branch = Window.partitionBy(*parts, "_branch")
    in_group = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    branches = leaves.groupBy(*parts, "_branch").agg(F.sum("_n").alias("_n"))
    branches = branches.select(
        *parts, "_branch", F.sum("_n").over(in_group).alias("_tot"),
        F.coalesce(F.sum("_n").over(in_group.orderBy("_branch").rowsBetween(*before)), F.lit(0))
        .alias("_off_branch"))
    leaves = leaves.select(
        *parts, "_branch", "_leaf",
        F.coalesce(F.sum("_n").over(in_branch.orderBy("_leaf").rowsBetween(*before)), F.lit(0))
        .alias("_off_leaf")).join(branches, [*parts, "_branch"]).drop("_branch")
    rank = [order_col] + ([tiebreak] if tiebreak else [])
    rn = F.row_number().over(Window.partitionBy(*parts, "_leaf").orderBy(*rank))
    out = b.drop("_branch").withColumn("_rn", rn).join(leaves, [*parts, "_leaf"])
    out = out.withColumn(
        pos_col, (F.col("_off_branch") + F.col("_off_leaf") + F.col("_rn") - 1).cast("long"))
    if size_col:
        out = out.withColumn(size_col, F.col("_tot").cast("long"))
    return out.drop("_leaf", "_rn", "_off_branch", "_off_leaf", "_tot")


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """0-based position of every row in the total order ``order`` (rows must be distinct in
    it), computed without a single-task window.

    Rows are range-partitioned and sorted by ``order``; ``monotonically_increasing_id`` then
    encodes (partition, position in partition). The table is checkpointed so partition ids
    stay fixed, per-partition counts (one row per partition, a proven bound) are
    prefix-summed and broadcast back.
    """
    from stratum.session import reliable_checkpoint
    parts = default_buckets(df)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .withColumn("_mid", F.monotonically_increasing_id())
    ranged = reliable_checkpoint(ranged)
    mask = (1 << 33) - 1
    ranged = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33)) \
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(mask)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(rank_col, (F.col("_off") + F.col("_loc")).cast("long")) \
        .drop("_mid", "_pid", "_loc", "_off")
