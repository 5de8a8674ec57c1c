"""Per-class k-means."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.knn import _centre_distances
from stratum.operators.subsets import rows_of_class

#: Distances to centres that a round's task holds at once.
NEAREST_PAIRS = 1 << 15


def class_clusters(minority: DataFrame, k: int, seed: int = 1, max_iter: int = 20,
                   parallel_fits: int = 4) -> DataFrame:
    """K-means inside every class; adds ``cluster int`` and ``k_eff`` (the k actually
    used: ``min(k, class size)``; k < 2 leaves the class as one cluster 0).

    One MLlib fit per class (distributed; classes are few, and a fit never pulls a class
    into one task). The class list and sizes are the only driver-side values.
    """
    sizes = {r["label"]: r["n"] for r in
             minority.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def fitted(label: int) -> DataFrame:
        rows = rows_of_class(minority, label)
        k_eff = min(k, sizes[label])
        if k_eff < 2:
            return rows.withColumn("cluster", F.lit(0)).withColumn("k_eff", F.lit(1))
        vec = rows.withColumn("_v", array_to_vector("features"))
        model = KMeans(k=k_eff, seed=seed, maxIter=max_iter, featuresCol="_v",
                       predictionCol="cluster").fit(vec)
        return (model.transform(vec).drop("_v").withColumn("cluster", F.col("cluster").cast("int"))
                .withColumn("k_eff", F.lit(k_eff)))

    with ThreadPoolExecutor(max_workers=max(1, parallel_fits)) as workers:
        parts = list(workers.map(fitted, sorted(sizes)))
    if not parts:
        return minority.withColumn("cluster", F.lit(0)).withColumn("k_eff", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b), parts)


def keyed_clusters(rows: DataFrame, ks: Sequence[int], keys: Sequence[str] = (), seed: int = 1,
                   max_iter: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """C1 for many groups and many k at once: k-means inside every class of every key.

    Returns the rows once for each k of ``ks``, with ``k``, ``cluster`` and ``k_eff`` (the k
    used: ``min(k, rows of the class)``; below 2 the class is one cluster 0). All groups and
    ks share each round: a round is one scan that adds up every cluster's rows within the
    tasks and one aggregate, so a grid of folds and ks takes ``max_iter`` jobs at most where
    a fit per group would take that many for each. Rounds end when no centre moves by more
    than ``tolerance``. ``rows`` is read once a round, so hand in a checkpointed table.

    The first centres are the rows of least hash, the same for each k. The centres (keys x
    classes x ks, bounded by the grid and not by the rows) are what the driver holds. An
    empty table gives an empty result.
    """
    by = [*keys, "label"]
    ks = sorted({max(1, int(k)) for k in ks})
    order = [F.xxhash64(F.lit(seed), "index"), F.col("index")]
    first = Window.partitionBy(*by).orderBy(*order)
    starts = (rows.select(*by, "index", "features").withColumn("rn", F.row_number().over(first))
              .where(F.col("rn") <= ks[-1]).orderBy(*by, "rn").collect())
    if not starts:
        return rows.select("*", *[F.lit(None).cast("int").alias(c) for c in ("k", "cluster", "k_eff")])
    groups: dict = {}
    for r in starts:
        groups.setdefault(tuple(r[c] for c in by), []).append(r["features"])
    spark = rows.sparkSession
    key_types = [rows.schema[c] for c in by]
    # a row per group: keys x classes
    ids = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], T.StructType([*key_types, T.StructField("_group", T.IntegerType())]))
    numbered = rows.join(F.broadcast(ids), by)
    centres = [{k: np.array(x[:k], dtype=np.float64) for k in ks} for x in groups.values()]
    width = len(starts[0]["features"])

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        step = max(1, NEAREST_PAIRS // len(c))  # distances that stay in a core's cache
        return np.concatenate([np.argmin(_centre_distances(x[i:i + step], c), axis=1) for i in range(0, len(x), step)])

    def sums(shared):
        def run(batches):
            total: dict = {}
            for batch in batches:
                for g, part in batch.groupby("_group"):
                    x = np.stack(part["features"].to_numpy())
                    for k, c in shared.value[g].items():
                        own = nearest(x, c)
                        n = np.bincount(own, minlength=len(c))
                        add = np.column_stack([np.bincount(own, column, minlength=len(c)) for column in x.T])
                        old = total.get((g, k))
                        total[g, k] = (add, n) if old is None else (old[0] + add, old[1] + n)
            out = [(g, k, j, int(n[j]), *map(float, add[j])) for (g, k), (add, n) in total.items() for j in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=["g", "k", "cluster", "n", *[f"s{i}" for i in range(width)]])
        return run

    ddl = "g int, k int, cluster int, n long, " + ", ".join(f"s{i} double" for i in range(width))
    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast(centres)
        part = numbered.select("_group", "features").mapInPandas(sums(shared), ddl)
        moved = 0.0
        found = part.groupBy("g", "k", "cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        fresh = [{k: c.copy() for k, c in g.items()} for g in centres]
        for r in found.collect():  # a row per centre
            new = np.array([r[f"s{i}"] for i in range(width)]) / r["n"]
            moved = max(moved, float(np.abs(new - fresh[r["g"]][r["k"]][r["cluster"]]).max()))
            fresh[r["g"]][r["k"]][r["cluster"]] = new
        centres = fresh
        shared.unpersist()
        if moved <= tolerance:
            break
    last = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<struct<k:int,cluster:int,k_eff:int>>")
    def assigned(group: pd.Series, features: pd.Series) -> pd.Series:
        out = np.empty(len(group), dtype=object)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            x = np.stack(features.to_numpy()[at])
            own = {k: (nearest(x, c), len(c)) for k, c in last.value[g].items()}
            for j, i in enumerate(at):
                out[i] = [{"k": k, "cluster": int(c[j]), "k_eff": n} for k, (c, n) in own.items()]
        return pd.Series(out)

    every = numbered.withColumn("_c", F.explode(assigned("_group", "features")))
    return every.select(*rows.columns, "_c.*")
