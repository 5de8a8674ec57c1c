"""Approximate neighbours through cells of two levels.

The cells' centres are themselves clustered: about sqrt(n_cells) groups, each with a share of
the cells. A row meets the groups' centres and then only the centres of the groups it
probes, so fitting and probing cost about sqrt(n_cells) distances a row. The groups' centres
travel with the code (sqrt(n_cells) rows); the cells' centres are a table that meets the
rows by an equi-join on the group, never one array.

How many groups and cells a query probes is measured: for a bounded sample of rows the exact
neighbours are found, and the ranks of their cells in the sample's own probing order say how
far one must go for the recall that is asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.exprs import squared_distance
from stratum.operators.knn import (DEFAULT_BLOCK_ROWS, _centre_distances, _kernel_partitions, _matrix,
                                   blocked_neighbours, fit_cells, knn, nearest_cells)
from stratum.session import reliable_checkpoint

#: Rows that a centre is fitted on, of either level; rows that the probing depth is measured on.
FIT_ROWS, RECALL_ROWS = 256, 400
#: A group has at most this many times the mean number of cells.
MOST_CELLS = 4
#: What the measured recall must have beyond the one asked for.
RECALL_MARGIN = 0.02
LLOYD_ROUNDS = 10
#: Rows of one leaf-search task.
SEARCH_ROWS = 20_000


@dataclass
class CellTree:
    """Centres of the groups, ``leaves`` (group, cell, centre) and ``rows`` (index, label, features, cell)."""

    groups: np.ndarray
    leaves: DataFrame
    rows: DataFrame
    n_cells: int
    stride: int


def _part(rows: DataFrame, share) -> DataFrame:
    """About ``share`` of the rows, chosen by their index alone."""
    return rows.where(F.pmod(F.xxhash64("index", F.lit(11)), F.lit(1 << 30)) < F.lit(share) * float(1 << 30))


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres of a bounded sample; empty ones go."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(LLOYD_ROUNDS):
        own = np.concatenate([np.argmin(_centre_distances(x[i:i + 4096], centres), axis=1) for i in range(0, len(x), 4096)])
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _with_leaves(rows: DataFrame, leaves: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Rows that name a ``group`` beside that group's cells, by tasks of ``SEARCH_ROWS`` rows.

    ``fn(rows, cells, centres)`` sees one task's rows. A group that many rows probe is dealt
    to many tasks, each with the group's cells, of which a group has few."""
    subs = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SEARCH_ROWS).cast("int").alias("subs"))
    subs = reliable_checkpoint(subs, cache=False)  # a row per group
    side = F.broadcast(subs)
    q = rows.join(side, "group").withColumn("sub", F.pmod(F.xxhash64("index", F.lit(5)), F.col("subs")).cast("int")).drop("subs")
    c = leaves.join(side, "group").select(F.col("group").alias("c_group"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("c_sub"),
                                          "cell", "centre")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="object") for f in schema.fields})
        c = c.sort_values("cell")
        return fn(q, c["cell"].to_numpy(np.int32), _matrix(c["centre"]))

    parts = _kernel_partitions(rows)
    q = q.repartition(parts, "group", "sub").groupBy("group", "sub")
    c = c.repartition(parts, "c_group", "c_sub").groupBy("c_group", "c_sub")
    return q.cogroup(c).applyInPandas(run, schema)


def fit_tree(data: DataFrame, n_cells: int, seed: int = 42, fit_rows: int = FIT_ROWS) -> CellTree:
    """Fit both levels and put every row into its cell.

    The groups are fitted on about ``fit_rows`` sampled rows for each group, a group's cells
    on as many for each of its cells: bounded samples, chosen by a hash of the row's id. A
    group gets cells in proportion to its rows, up to ``MOST_CELLS`` times the mean; what is
    crowded beyond that is split by the search, as any large cell is."""
    n = data.count()
    n_cells = max(1, min(n_cells, n))
    n_groups = math.ceil(math.sqrt(n_cells))
    if n_groups > 1:
        groups = fit_cells(_part(data, min(1.0, n_groups * fit_rows / n)), n_groups, seed, max_iter=10)
    else:  # a single group needs no fit
        groups = _matrix(pd.Series([data.first()["features"]]))
    n_groups = len(groups)
    shared = data.sparkSession.sparkContext.broadcast(groups)
    grouped = reliable_checkpoint(data.select("index", "label", "features",
                                              nearest_cells(shared, 1)("features")[0].alias("group")), cache=False)
    stride = MOST_CELLS * math.ceil(n_cells / n_groups)
    per = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    quota = F.greatest(F.lit(1), F.least(F.lit(stride), F.round(F.col("n") * n_cells / n))).cast("int")
    per = per.select("group", quota.alias("quota"), (quota * fit_rows / F.col("n")).alias("share"))
    sample = _part(grouped.join(F.broadcast(per), "group"), 1.0).where(
        F.pmod(F.xxhash64("index", F.lit(13)), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    schema = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("centre", T.ArrayType(T.DoubleType()))])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        g = int(group["group"].iloc[0])
        centres = _lloyd(_matrix(group["features"]), int(group["quota"].iloc[0]), seed + g)
        return pd.DataFrame({"group": np.int32(g), "cell": (g * stride + np.arange(len(centres))).astype(np.int32),
                             "centre": list(centres)})

    leaves = reliable_checkpoint(sample.groupBy("group").applyInPandas(fit, schema))
    # a group none of whose rows fell into the sample has its own centre as its only cell
    empty = grouped.select("group").distinct().join(leaves.select("group").distinct(), "group", "left_anti")
    missing = [r["group"] for r in empty.collect()]
    if missing:
        more = [(g, g * stride, [float(v) for v in groups[g]]) for g in missing]
        leaves = reliable_checkpoint(leaves.unionByName(data.sparkSession.createDataFrame(more, schema)))
    out = T.StructType([T.StructField("index", T.LongType()), T.StructField("label", T.IntegerType()),
                        T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def place(q: pd.DataFrame, cells: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
        own = np.argmin(_centre_distances(_matrix(q["features"]), centres), axis=1)
        return pd.DataFrame({"index": q["index"], "label": q["label"], "features": q["features"], "cell": cells[own]})

    rows = reliable_checkpoint(_with_leaves(grouped, leaves, place, out))
    return CellTree(groups, leaves, rows, leaves.count(), stride)


def probe_cells(tree: CellTree, queries: DataFrame, n_groups: int, n_probe: int) -> DataFrame:
    """``index, label, features, probes``: each query's ``n_probe`` nearest cells in its ``n_groups`` nearest groups."""
    shared = queries.sparkSession.sparkContext.broadcast(tree.groups)
    near = queries.select("index", "label", "features", nearest_cells(shared, n_groups)("features").alias("near"))
    each = near.select("index", "label", "features", F.posexplode("near").alias("rank", "group"))
    schema = T.StructType([
        T.StructField("index", T.LongType()), T.StructField("label", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("cell", T.IntegerType())])))])

    def search(q: pd.DataFrame, cells: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
        dist = _centre_distances(_matrix(q["features"]), centres)
        best = np.argsort(dist, axis=1, kind="stable")[:, :n_probe]
        found = [[{"d2": float(d[c]), "cell": int(cells[c])} for c in b] for d, b in zip(dist, best, strict=True)]
        # the features are kept once, beside the nearest group
        features = [f if r == 0 else None for f, r in zip(q["features"], q["rank"], strict=True)]
        return pd.DataFrame({"index": q["index"], "label": q["label"], "features": features, "cells": found})

    found = _with_leaves(each, tree.leaves, search, schema)
    merged = found.groupBy("index", "label").agg(F.first("features", ignorenulls=True).alias("features"),
                                                 F.sort_array(F.flatten(F.collect_list("cells"))).alias("cells"))
    return merged.select("index", "label", "features", F.transform(F.slice("cells", 1, n_probe), lambda c: c["cell"]).alias("probes"))


def probing_depth(tree: CellTree, k: int, recall: float = 0.9, sample_rows: int = RECALL_ROWS,
                  block_rows: int = DEFAULT_BLOCK_ROWS) -> tuple[int, int]:
    """Groups and cells that a query must probe for ``recall``, measured on ``sample_rows`` rows.

    The sample's exact neighbours cost ``sample_rows`` distances a row of the data. Of each
    neighbour two numbers come to the driver: the rank of its group, and of its cell among
    the cells of the groups that are probed."""
    spark = tree.rows.sparkSession
    sample = reliable_checkpoint(tree.rows.orderBy(F.xxhash64("index", F.lit(3)), "index").limit(sample_rows))
    n = max(tree.rows.count(), 1)
    exact = blocked_neighbours(
        sample.select("index", "label", "features", F.array(F.lit(0)).alias("probes")),
        tree.rows.select("index", "label", "features", F.lit(0).alias("cell")), k, exclude_self=True,
        fixed_splits=(min(n, max(math.ceil(n / block_rows), spark.sparkContext.defaultParallelism)), 1))
    shared = spark.sparkContext.broadcast(tree.groups)
    order = nearest_cells(shared, len(tree.groups))("features")
    # the sample and its pairs are bounded by sample_rows and k
    pairs = (tree.rows.select(F.col("index").alias("n_index"), "cell")
             .join(F.broadcast(exact.select("index", "n_index")), "n_index")
             .withColumn("group", F.floor(F.col("cell") / tree.stride).cast("int")))
    pairs = (tree.leaves.select("cell", "centre").join(F.broadcast(pairs), "cell")
             .join(F.broadcast(sample.select("index", "features", order.alias("order"))), "index")
             .select("index", "n_index", F.array_position("order", F.col("group")).cast("int").alias("rank"),
                     squared_distance("features", "centre").alias("limit")))
    pairs = reliable_checkpoint(pairs)
    ranks = np.sort(np.array([r["rank"] for r in pairs.select("rank").collect()]))
    if not len(ranks):
        return len(tree.groups), tree.n_cells
    wanted = min(1.0, recall + RECALL_MARGIN)
    n_groups = int(ranks[min(len(ranks), math.ceil(len(ranks) * (1 + wanted) / 2)) - 1])
    limits = pairs.where(F.col("rank") <= n_groups).groupBy("index").agg(F.sort_array(F.collect_list("limit")).alias("limits"))
    asked = (sample.select("index", "features", F.slice(order, 1, n_groups).alias("near")).join(limits, "index")
             .select("index", "features", "limits", F.explode("near").alias("group")))
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("nearer", T.LongType())])

    def count(q: pd.DataFrame, cells: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
        dist = np.sort(_centre_distances(_matrix(q["features"]), centres), axis=1)
        rows = [(i, at, int(np.searchsorted(d, limit * (1 + 1e-12), side="right")))
                for i, d, limits in zip(q["index"], dist, q["limits"], strict=True) for at, limit in enumerate(limits)]
        return pd.DataFrame(rows, columns=["index", "at", "nearer"])

    depth = _with_leaves(asked, tree.leaves, count, schema).groupBy("index", "at").agg(F.sum("nearer").alias("depth"))
    depths = np.sort(np.array([r["depth"] for r in depth.select("depth").collect()]))
    needed = math.ceil(len(ranks) * wanted)
    n_probe = int(depths[needed - 1]) if needed <= len(depths) else tree.n_cells
    return n_groups, max(1, min(n_probe, tree.n_cells))


def knn_tree(data: DataFrame, k: int, n_cells: int, recall: float = 0.9, query: DataFrame | None = None, *,
             seed: int = 42, block_rows: int = DEFAULT_BLOCK_ROWS, tree: CellTree | None = None,
             depth: tuple[int, int] | None = None) -> DataFrame:
    """K4: approximate neighbours at a measured recall; the same table as :func:`knn.knn`.

    Without ``query`` every row is a query and not its own neighbour. ``tree`` and ``depth``
    (groups and cells to probe) may be handed in to be used again. Queries that find fewer
    than k rows search again with four times the groups and cells, until none is short."""
    if tree is None and data.isEmpty():
        return knn(data, k, query, n_rows=0)
    tree = tree or fit_tree(data, n_cells, seed)
    n_groups, n_probe = depth or probing_depth(tree, k, recall, block_rows=block_rows)
    queries = (tree.rows if query is None else query).select("index", "label", "features")

    def search(rows: DataFrame) -> DataFrame:
        return blocked_neighbours(probe_cells(tree, rows, n_groups, n_probe), tree.rows, k, exclude_self=query is None,
                                  block_rows=block_rows, max_cells=tree.n_cells)

    found = reliable_checkpoint(search(queries), cache=False)
    while n_probe < tree.n_cells or n_groups < len(tree.groups):
        full = found.where(F.col("rn") == k).select("index")
        short = queries.join(full, "index", "left_anti")
        if short.isEmpty():
            break
        n_groups, n_probe = min(4 * n_groups, len(tree.groups)), min(4 * n_probe, tree.n_cells)
        found = reliable_checkpoint(found.join(full, "index", "left_semi").unionByName(search(short)), cache=False)
    return found
