"""Same-class search and distance sums that skip far cells.

Every class is cut into k-means cells. A cell has an exact centre of gravity, a radius, a row
count and the sum of its rows' squared distances from the centre. From these follow bounds
that spare most pairs:

* nearest row of the same class: a cell whose ball begins beyond the distance found so far
  cannot hold a nearer row. Cells are probed best first, one, then two, four, ..., until the
  next one begins too far away.
* sum of distances to the class: for a row at distance D of a cell with m rows, radius r < D
  and squared spread S, the sum lies between m D (the distance is convex) and
  m D + S / (2 (D - r)) (its curvature is 1 / distance at most). Where half the gap is within
  the tolerance, the middle is taken; other cells are summed row by row.

The cells' numbers, ``cells`` rows a class at most, travel with the code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.clusters import keyed_clusters
from stratum.operators.knn import DEFAULT_BLOCK_ROWS, _centre_distances, _cogroup, _distance_sums, _kernel_partitions, _matrix, blocked_neighbours
from stratum.session import reliable_checkpoint

#: Most cells of a class; their numbers are held by every task.
MAX_CELLS = 256
#: Relative slack of the bounds, for rounding.
SLACK = 1e-9


@dataclass
class ClassCells:
    """``rows`` (index, label, features, cell) and, by label, the cells' ids, centres, sizes, radii and spreads."""

    rows: DataFrame
    by_label: dict[int, tuple[np.ndarray, ...]]
    n_cells: int


def class_cells(data: DataFrame, cells: int, seed: int = 1) -> ClassCells:
    """Cut every class into ``cells`` cells at most (256 in any case), and measure them."""
    cells = max(1, min(cells, MAX_CELLS))
    base = reliable_checkpoint(data.select("index", "label", "features"))
    placed = reliable_checkpoint(keyed_clusters(base, [cells], seed=seed, max_iter=8).select("index", "label", "features", "cluster"))
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    # a row per class and cell, as all that follows here
    means = placed.groupBy("label", "cluster").agg(
        Summarizer.mean(array_to_vector("features")).alias("centre"), F.count(F.lit(1)).alias("n")).orderBy("label", "cluster").collect()
    ids = {(r["label"], r["cluster"]): i for i, r in enumerate(means)}
    centres = np.array([r["centre"].toArray() for r in means])
    spark = data.sparkSession
    numbers = spark.createDataFrame([(*key, i) for key, i in ids.items()], "label int, cluster int, cell int")
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf(T.DoubleType())
    def own_square(features: pd.Series, cell: pd.Series) -> pd.Series:
        diff = _matrix(features) - shared.value[cell.to_numpy()]
        return pd.Series((diff * diff).sum(axis=1))

    rows = placed.join(F.broadcast(numbers), ["label", "cluster"]).select("index", "label", "features", "cell")
    spread = {r["cell"]: (r["r2"], r["s"]) for r in rows.select("cell", own_square("features", "cell").alias("d2"))
              .groupBy("cell").agg(F.max("d2").alias("r2"), F.sum("d2").alias("s")).collect()}
    by_label = {}
    for label in {r["label"] for r in means}:
        own = np.array([ids[r["label"], r["cluster"]] for r in means if r["label"] == label])
        by_label[label] = (own.astype(np.int32), centres[own], np.array([means[i]["n"] for i in own], dtype=np.float64),
                           np.sqrt([spread[i][0] for i in own]), np.array([spread[i][1] for i in own]))
    return ClassCells(rows, by_label, len(means))


def _by_label(labels: pd.Series):
    values = labels.to_numpy()
    for label in np.unique(values):
        yield label, np.flatnonzero(values == label)


def _next_cells(shared):
    """Pandas UDF: of a class's cells by their least possible distance, the ``width`` next ones that begin
    within the distance found so far; ``probed`` have been seen."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probes(labels: pd.Series, features: pd.Series, found: pd.Series, probed: pd.Series, width: pd.Series) -> pd.Series:
        out = np.empty(len(labels), dtype=object)
        limits, done, wide = found.to_numpy(dtype=np.float64), probed.to_numpy(), width.to_numpy()
        for label, at in _by_label(labels):
            ids, centres, _, radii, _ = shared.value[label]
            for some in np.array_split(at, max(1, len(at) * len(ids) >> 20)):
                least = np.sqrt(_centre_distances(_matrix(features.iloc[some]), centres)) - radii[None, :]
                order = np.argsort(np.maximum(least, 0), axis=1, kind="stable")  # ids ascend
                for i, row, by in zip(some, least, order, strict=True):
                    next_ones = by[done[i]:done[i] + wide[i]]
                    out[i] = ids[next_ones[row[next_ones] * (1 - SLACK) - SLACK < limits[i]]].tolist()
        return pd.Series(out)

    return probes


def nearest_same_class_bounded(data: DataFrame, cells: int = 16, *, seed: int = 1,
                               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K5, exact: ``index, label, distance`` to the nearest other row of the class (NULL where there is
    none) and ``probed``, the cells of the class that were looked into.

    Each round probes the next cells of the rows that are not done; its result is
    checkpointed. A class of identical or unclustered rows is searched whole."""
    tree = class_cells(data, cells, seed)
    spark = data.sparkSession
    next_cells = _next_cells(spark.sparkContext.broadcast(tree.by_label))
    infinite = F.lit(float("inf"))
    state = tree.rows.select("index", "label", "features", infinite.alias("found"), F.lit(0).alias("probed"))
    width, done = 1, []
    while True:
        asked = reliable_checkpoint(state.withColumn("probes", next_cells("label", "features", "found", "probed", F.lit(width))),
                                    cache=False)
        done.append(asked.where(F.size("probes") == 0).select("index", "label", "found", "probed"))
        still = asked.where(F.size("probes") > 0)
        if still.isEmpty():
            break
        hit = blocked_neighbours(still.select("index", "label", "features", "probes"), tree.rows, 1, exclude_self=True,
                                 block_rows=block_rows, max_cells=tree.n_cells).select("index", F.sqrt("d2").alias("d"))
        state = still.join(hit, "index", "left").select(
            "index", "label", "features", F.least("found", F.coalesce("d", infinite)).alias("found"),
            # what begins beyond the distance found ends the search, so the next look starts behind these
            (F.col("probed") + F.size("probes")).cast("int").alias("probed"))
        width *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("index", "label", F.when(F.col("found") < infinite, F.col("found")).alias("distance"), "probed")


def _block_sums(query: DataFrame, data: DataFrame, block_rows: int) -> DataFrame:
    """``index, near``: sum of distances from each query to the rows of the cells it probes; one
    row per query and block leaves the kernel."""
    sizes = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("ds"))
    asked = query.select("index", "features", F.explode("probes").alias("cell"))
    splits = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("qs")), "cell")
    splits = reliable_checkpoint(splits, cache=False)  # a row per cell
    groups = splits.agg(F.sum(F.col("ds").cast("long") * F.col("qs"))).first()[0] or 1
    splits = F.broadcast(splits)
    d = (data.join(splits, "cell").withColumn("dsub", F.pmod(F.xxhash64("index"), F.col("ds")).cast("int"))
         .select("cell", "dsub", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qsub"), "features"))
    q = (asked.join(splits, "cell").withColumn("qsub", F.pmod(F.xxhash64("index", F.lit(7)), F.col("qs")).cast("int"))
         .select("cell", F.explode(F.sequence(F.lit(0), F.col("ds") - 1)).alias("dsub"), "qsub", "index", F.col("features").alias("q")))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"index": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        return pd.DataFrame({"index": q["index"], "s": _distance_sums(_matrix(q["q"]), _matrix(d["features"]))})

    part = _cogroup(q, d, ["cell", "dsub", "qsub"], run, "index long, s double",
                    max(_kernel_partitions(data), _kernel_partitions(data, groups)))
    return part.groupBy("index").agg(F.sum("s").alias("near"))


def average_distance_bounded(data: DataFrame, tolerance: float = 0.01, cells: int = 16, *, seed: int = 1,
                             block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K6 within a stated error: ``index, label, avg_distance, near_cells``.

    The average distance to the other rows of the class differs from the exact one by
    ``tolerance`` times it at most; with 0 every cell with any spread is summed row by row.
    ``near_cells`` counts those that were. NULL for a class of one row."""
    tree = class_cells(data, cells, seed)
    shared = data.sparkSession.sparkContext.broadcast(tree.by_label)

    @F.pandas_udf("struct<far:double,near:array<int>,n:double>")
    def far_sum(labels: pd.Series, features: pd.Series) -> pd.DataFrame:
        far, near, n = np.zeros(len(labels)), np.empty(len(labels), dtype=object), np.zeros(len(labels))
        for label, at in _by_label(labels):
            ids, centres, sizes, radii, spreads = shared.value[label]
            for some in np.array_split(at, max(1, len(at) * len(ids) >> 20)):
                dist = np.sqrt(_centre_distances(_matrix(features.iloc[some]), centres))
                room = dist - radii[None, :]
                half = spreads[None, :] / (4 * np.where(room > 0, room, np.nan))
                is_far = (room > 0) & (half <= tolerance * sizes[None, :] * dist)
                far[some] = np.where(is_far, sizes[None, :] * dist + np.nan_to_num(half), 0.0).sum(axis=1)
                n[some] = sizes.sum()
                for i, mask in zip(some, is_far, strict=True):
                    near[i] = ids[~mask].tolist()
        return pd.DataFrame({"far": far, "near": near, "n": n})

    asked = reliable_checkpoint(tree.rows.select("index", "label", "features", far_sum("label", "features").alias("s"))
                                .select("index", "label", "features", "s.far", F.col("s.near").alias("probes"), "s.n"), cache=False)
    near = _block_sums(asked, tree.rows, block_rows)
    total: Column = F.col("far") + F.coalesce("near", F.lit(0.0))
    return asked.join(near, "index", "left").select(
        "index", "label", F.when(F.col("n") > 1, total / (F.col("n") - 1)).alias("avg_distance"), F.size("probes").alias("near_cells"))
