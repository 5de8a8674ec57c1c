"""Entry B/C of the workload: folds x methods x grade subsets (x clusters x cutoffs),
a model per cell, ten metrics per cell (SURVEY V1-V6, L1, S4).

Resampling, prediction, confusion and metrics are DataFrame plans; the loop only drives
model fits (one MLlib fit per cell, which is the workload) and brings back one metrics
row per cell. Fits of one fold can run concurrently from a thread pool, so a large
cluster is not left idle by small fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.clusters import keyed_clusters
from stratum.operators.common import default_buckets
from stratum.operators.folds import assign_folds, fold_split
from stratum.operators.metrics import METRIC_NAMES, class_rates, confusion, metrics
from stratum.operators.model import random_forest_predict
from stratum.operators.resample import resample, smote_plus_rows
from stratum.operators.subsets import filter_all_subsets, filter_types, subset_list
from stratum.session import collect_garbage, reliable_checkpoint

RESULT_SCHEMA = T.StructType(
    [T.StructField("fold", T.IntegerType()), T.StructField("index", T.IntegerType()),
     T.StructField("sampling", T.StringType()), T.StructField("minority_types", T.StringType()),
     T.StructField("clusters", T.IntegerType()), T.StructField("cutoff", T.DoubleType()),
     T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType())]
    + [T.StructField(m, T.DoubleType()) for m in METRIC_NAMES]
    + [T.StructField("n_classes_scored", T.LongType()), T.StructField("status", T.StringType())])


def _types_text(types: Sequence[int]) -> str:
    return "[" + " ".join(str(t) for t in types) + "]"


# Rows per partition of a model fit: a fit runs a dozen small jobs over its training rows and one
# over the test rows, whose tasks should not outnumber the work (the driver keeps each one's figures).
FIT_ROWS = 50_000
#: Fits after which the driver's garbage is collected: each leaves a model, its summary and some plans.
FITS_KEPT = 10


def _parts(n_rows: int) -> int:
    return max(1, -(-n_rows // FIT_ROWS))


def _fit_confusion(train: DataFrame, test: DataFrame, n_train: int, num_trees: int, seed: int,
                   num_classes: int | None) -> list[tuple]:
    """Fit one forest on a persisted training slice; the confusion of its predictions, a few rows."""
    train = train.coalesce(_parts(n_train)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pred = random_forest_predict(train, test, num_trees, seed, num_classes)
        return [tuple(r) for r in confusion(pred).collect()]
    finally:
        train.unpersist()


def _plus_targets(counts: dict, types, cutoff: float) -> tuple[int | None, dict, set]:
    """Of one clustering and (subset, cutoff): training rows (None where a class keeps no row),
    the new rows of every class, and the kept clusters. ``counts``: (label, cluster) to rows
    by grade (F5, F6)."""
    kept = {c for c, by in counts.items()
            if any(by.get(t, 0) for t in types) and sum(by.get(t, 0) for t in types) >= sum(by.values()) * cutoff}
    sizes: dict = {}
    for label, cluster in kept:
        sizes[label] = sizes.get(label, 0) + sum(counts[label, cluster].get(t, 0) for t in types)
    half = max(sizes.values(), default=0) // 2
    new = {label: half - n for label, n in sizes.items() if n < half}
    every = {label for label, _ in counts}
    return (sum(sizes.values()) + sum(new.values()) if sizes and set(sizes) == every else None), new, kept


def _plus_cells(train: DataFrame, fold_ids, subsets, cluster_ks, cutoffs, pool: str, seed: int, cluster_seed: int):
    """V4: what every SMOTE+ cell of some folds trains on, by one clustering and one draw plan.

    ``train``: the training rows, keyed by ``fold``. All folds and ks are clustered together.
    A draw depends on the seed, the class and its number, not on the grade subset, so the
    rows drawn from a whole class for (fold, k) serve every subset and cutoff: a cell takes
    the first m of them. Where the pool is the ``selected`` rows, the subset and cutoff are
    keys too. Returns the tables to release and a function (fold, types, k, cutoff) to the
    cell's clustered rows (None: all of the selected grades), synthetic rows and number of rows.
    """
    spark = train.sparkSession
    clustered = reliable_checkpoint(keyed_clusters(train, cluster_ks, ["fold"], cluster_seed))
    counts: dict = {}
    # at most folds x ks x classes x clusters x grades rows
    for r in clustered.groupBy("fold", "k", "label", "cluster", "minority_type").count().collect():
        counts.setdefault((r["fold"], r["k"]), {}).setdefault((r["label"], r["cluster"]), {})[r["minority_type"]] = r["count"]
    targets = {(f, k, tuple(types), cutoff): _plus_targets(counts.get((f, max(k, 1)), {}), types, cutoff)
               for f in fold_ids for k in cluster_ks for types in subsets for cutoff in cutoffs}
    cell_ids = {(tuple(types), cutoff): i for i, (types, cutoff) in enumerate((t, c) for t in subsets for c in cutoffs)}
    shared = pool == "class"
    most: dict = {}
    for (f, k, types, cutoff), (n, new, _) in targets.items():
        for label, m in new.items() if n else ():
            at = (f, max(k, 1), 0 if shared else cell_ids[types, cutoff], label)
            most[at] = max(m, most.get(at, 0))
    need = spark.createDataFrame([(*at, m) for at, m in most.items()], "fold int, k int, cell int, label int, m long")
    if shared:
        rows = clustered.withColumn("cell", F.lit(0))
    else:  # the selected rows of every (subset, cutoff) cell
        kept = spark.createDataFrame([(f, max(k, 1), cell_ids[types, cutoff], label, cluster, list(types))
                                      for (f, k, types, cutoff), (n, _, clusters) in targets.items() if n for label, cluster in clusters],
                                     "fold int, k int, cell int, label int, cluster int, types array<int>")
        rows = clustered.join(F.broadcast(kept), ["fold", "k", "label", "cluster"]).where(F.array_contains("types", F.col("minority_type")))
    keys = ["fold", "k", "cell"]
    made = smote_plus_rows(None, rows.select(*keys, "label", "cluster", "index", "features"), F.col("k"), seed, keys, need)
    # laid out as the cells read them: a fit skips the cached batches of other folds and ks
    order = [*keys, "label", F.floor(F.col("draw") / FIT_ROWS)]
    made = reliable_checkpoint(made.repartition(default_buckets(made), *order).sortWithinPartitions(*keys, "label", "draw"))

    def cell(fold: int, types, k: int, cutoff: float):
        n, new, kept = targets[fold, k, tuple(types), cutoff]
        if n is None:
            return None, None, None
        chosen = None
        if any(any(by.get(t, 0) for t in types) for c, by in counts[fold, max(k, 1)].items() if c not in kept):
            by_label: dict = {}
            for label, cluster in kept:
                by_label.setdefault(label, []).append(cluster)
            chosen = clustered.where((F.col("fold") == fold) & (F.col("k") == max(k, 1)) & F.col("minority_type").isin(list(types))
                                     & reduce(lambda a, b: a | b, [(F.col("label") == label) & F.col("cluster").isin(some)
                                                                   for label, some in by_label.items()]))
        drawn = [(F.col("label") == label) & (F.col("draw") <= m) for label, m in new.items()]
        extra = made.where((F.col("fold") == fold) & (F.col("k") == max(k, 1))
                           & (F.col("cell") == (0 if shared else cell_ids[tuple(types), cutoff]))
                           & reduce(lambda a, b: a | b, drawn, F.lit(False)))
        return chosen, extra, n

    return [clustered, made], cell


def run_experiment(minority: DataFrame, methods: Sequence[str] = ("none", "undersample",
                                                                  "oversample", "smote"),
                   subsets: Sequence[Sequence[int]] | None = None, num_splits: int = 5,
                   folds: Sequence[int] | None = None,
                   cluster_ks: Sequence[int] = (2, 5, 10, 25, 50),
                   cutoffs: Sequence[float] = (0.0,), num_trees: int = 10, seed: int = 42,
                   cluster_seed: int = 1, parallel_fits: int = 4, pool: str = "class",
                   regrade: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None
                   ) -> DataFrame:
    """Result table, one row per (fold, cell), columns of ``RESULT_SCHEMA``.

    ``minority``: graded table ``index, label, minority_type, features`` (scaled). Folds are
    contiguous by index rank (V1); train = the other folds of the minority table, test =
    this fold (V2). ``smotePlus`` expands over ``cluster_ks`` x subsets x ``cutoffs`` (V4);
    the other methods over subsets (V3). A cell whose training set is empty, or for
    ``smotePlus`` lacks a class, yields a row with ``status = 'empty_class'`` and no metrics.
    ``index`` restarts per fold and also advances over empty cells (V6).

    ``pool`` names the rows SMOTE+ draws from: the whole ``class`` or only the ``selected``
    grades. ``regrade(train, test)``, where given, scales and grades each fold's rows anew
    from its training rows alone and returns both.
    """
    if pool not in ("class", "selected"):
        raise ValueError("pool is 'class' or 'selected'")
    spark = minority.sparkSession
    subsets = [list(s) for s in (subsets or subset_list())]
    all_subsets = subset_list()
    subset_ids = [all_subsets.index(sorted(t)) for t in subsets]
    cutoffs = [float(c) for c in cutoffs]
    fold_ids = list(folds if folds is not None else range(max(num_splits, 1)))
    # lineage cut once: every fold, cell and model fit starts from this written table
    with_folds = reliable_checkpoint(assign_folds(minority, num_splits))
    num_classes = (with_folds.agg(F.max("label")).first()[0] or 0) + 1
    plus = None
    if "smotePlus" in methods and regrade is None:
        others = F.filter(F.array(*[F.lit(int(f)) for f in fold_ids]), lambda x: x != F.col("fold"))
        plus = _plus_cells(with_folds.withColumn("fold", F.explode(others)), fold_ids, subsets, cluster_ks, cutoffs,
                           pool, seed, cluster_seed)
    out: list[tuple] = []
    for f in fold_ids:
        train, test = (part.drop("fold") for part in fold_split(with_folds, f))
        if regrade is not None:
            train, test = regrade(train, test)
        train, test = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in (train, test))
        n_test = test.count()
        cached = [train, test]
        # every fit of the fold predicts these rows: few tasks each time, whatever wrote them
        test = test.coalesce(_parts(n_test)).persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(test)
        cells = []  # (method, types, clusters, cutoff, train slice, its rows or None when empty)
        for method in methods:
            if method == "smotePlus":
                mine = plus or _plus_cells(train.withColumn("fold", F.lit(int(f))), [f], subsets, cluster_ks, cutoffs, pool,
                                           seed, cluster_seed)
                if plus is None:
                    cached += mine[0]
                for k in cluster_ks:
                    for types in subsets:
                        for cutoff in cutoffs:
                            chosen, extra, n = mine[1](f, types, k, cutoff)
                            if n is not None:
                                chosen = filter_types(train, types) if chosen is None else chosen
                                chosen = chosen.select("label", "features").unionByName(extra.select("label", "features"))
                            cells.append((method, types, k, cutoff, chosen, n))
            else:
                # every requested subset of this fold resampled in one keyed plan, written out:
                # the plan of each fit then starts from a scan, it does not carry the resampling
                keyed = reliable_checkpoint(resample(filter_all_subsets(train)
                                                     .where(F.col("subset_id").isin(subset_ids)),
                                                     method, seed, keys=["subset_id"]))
                cached.append(keyed)
                sizes = {r[0]: r[1] for r in keyed.groupBy("subset_id").count().collect()}
                cells += [(method, types, None, None, keyed.where(F.col("subset_id") == sid).drop("subset_id"),
                           sizes.get(sid)) for types, sid in zip(subsets, subset_ids, strict=True)]

        def run(i_cell, test=test, n_test=n_test):
            i, cell = i_cell
            if i % FITS_KEPT == FITS_KEPT - 1:
                collect_garbage(spark)
            if not cell[5] or not n_test:
                return []
            return [(i, *row) for row in _fit_confusion(cell[4], test, cell[5], num_trees, seed, num_classes)]

        with ThreadPoolExecutor(max_workers=max(1, parallel_fits)) as workers:
            found = [row for rows in workers.map(run, enumerate(cells)) for row in rows]
        # one evaluation plan for every cell of the fold, on their confusion counts
        conf = spark.createDataFrame(found, "cell int, label int, prediction int, n long")
        scores = {r["cell"]: r for r in metrics(class_rates(conf, ["cell"]), ["cell"]).collect()} if found else {}
        for i, (method, types, k, cutoff, _, n_train) in enumerate(cells):
            sc = scores.get(i)
            out.append((int(f), i, method, _types_text(types), k, cutoff, n_train, n_test,
                        *[sc[m] if sc else None for m in METRIC_NAMES],
                        sc["n_classes_scored"] if sc else None, "ok" if sc else "empty_class"))
        for c in cached:
            c.unpersist()
        cells.clear()
        cached.clear()
        collect_garbage(spark)  # the fold's tables go before the next one's are made
    for c in [with_folds, *(plus[0] if plus else ())]:
        c.unpersist()
    # one row per experiment cell: tiny, built from the collected metrics rows
    return spark.createDataFrame(out, RESULT_SCHEMA)
