"""The grid with the kNN-vote stand-in model, from shared candidate lists.

Every cell of the grid (fold x grade subset x method) trains on some of the other folds' rows,
original or made. One search finds, for every row and every grade, its k nearest original
rows of the other folds. The nearest originals of any subset are then a merge of at most four
sorted lists, so original rows are neither copied nor searched per subset:

* none: the merged list itself;
* oversample: the merged list with each row as often as it was drawn;
* smote: the merged list and the k nearest synthetic rows, which are searched per cell;
* undersample: the k nearest of the kept rows, searched per cell; these are few, since every
  class is cut to the smallest one.

What is numbered per cell to resolve draws are ids alone, of the classes that get new rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.exprs import draw_position, hash_number
from stratum.operators.aggregates import mean_of_arrays
from stratum.operators.common import dense_positions, join_rows, join_small
from stratum.operators.folds import assign_folds
from stratum.operators.box_search import knn_boxes_by
from stratum.operators.knn import blocked_neighbours, few_features, parallel_split
from stratum.operators.metrics import METRIC_NAMES, class_rates, confusion, metrics
from stratum.operators.model import majority
from stratum.operators.resample import METHODS, draw_table
from stratum.operators.subsets import filter_all_subsets, subsets_table
from stratum.session import reliable_checkpoint

N_SUBSETS = 15
CELL = ["fold", "subset_id"]
#: One candidate neighbour, in the order of preference: originals before made rows at a distance.
_CANDIDATE = ("d2", "made", "n_index", "draw", "n_label")


def grade_lists(folded: DataFrame, k: int) -> DataFrame:
    """``index, label, fold, near``: every row's k nearest rows of the other folds in each grade,
    as one sorted array of candidates with their grade."""
    rows = folded.select("index", "label", "features", F.col("fold").alias("part"), F.col("minority_type").alias("cell"))
    if few_features(rows, rows.count()):
        lists = knn_boxes_by(rows, k, "cell", range(4))
        entry = F.transform("near", lambda c: F.struct(c["d2"].alias("d2"), F.lit(False).alias("made"), c["n_index"].alias("n_index"),
                                                       F.lit(0).cast("long").alias("draw"), c["n_label"].alias("n_label"),
                                                       c["cell"].alias("grade")))
        return folded.select("index", "label", "fold").join(lists.select("index", F.sort_array(entry).alias("near")), "index")
    query = rows.drop("cell").withColumn("probes", F.array(*[F.lit(g) for g in range(4)]))
    nb = blocked_neighbours(query, rows, k, exclude_self=False, per_cell=True, skip_part=True, max_cells=4,
                            min_split=parallel_split(rows))
    entry = F.struct("d2", F.lit(False).alias("made"), "n_index", F.lit(0).cast("long").alias("draw"), "n_label",
                     F.col("cell").alias("grade"))
    lists = nb.groupBy("index").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    return folded.select("index", "label", "fold").join(lists, "index")


def _per_subset(lists: DataFrame, k: int) -> DataFrame:
    """``index, label, fold, subset_id, near``: the k nearest originals of every grade subset."""
    each = lists.withColumn("subset_id", F.explode(F.sequence(F.lit(0), F.lit(N_SUBSETS - 1))))
    # subset i keeps grade g where bit g of i is clear
    kept = F.expr("filter(near, c -> (shiftright(subset_id, c.grade) & 1) = 0)")
    plain = F.transform(F.slice(kept, 1, k), lambda c: F.struct(*[c[name].alias(name) for name in _CANDIDATE]))
    return each.select("index", "label", "fold", "subset_id", plain.alias("near"))


def training_counts(folded: DataFrame, num_splits: int) -> DataFrame:
    """``fold, subset_id, label, n, min_n, max_n`` of every cell's training rows, from one count
    by (fold, class, grade)."""
    by = folded.groupBy("fold", "label", "minority_type").agg(F.count(F.lit(1)).alias("n"))
    others = F.filter(F.sequence(F.lit(0), F.lit(num_splits - 1)), lambda x: x != F.col("fold"))
    each = filter_all_subsets(by.withColumn("fold", F.explode(others)))
    counts = each.groupBy(*CELL, "label").agg(F.sum("n").alias("n"))
    cell = Window.partitionBy(*CELL)
    return counts.select("*", F.min("n").over(cell).alias("min_n"), F.max("n").over(cell).alias("max_n"))


def _training_ids(ids: DataFrame, num_splits: int) -> DataFrame:
    """Ids in every cell they train: narrow rows, expanded inside the task."""
    others = F.filter(F.sequence(F.lit(0), F.lit(num_splits - 1)), lambda x: x != F.col("fold"))
    return filter_all_subsets(ids.withColumn("fold", F.explode(others)))


def kept_ids(ids: DataFrame, counts: DataFrame, most: int, num_splits: int, seed: int) -> DataFrame:
    """``fold, subset_id, index``: undersampling of every cell (the rows of least hash, R1).

    ``most`` is the largest number that any cell keeps of a class. Only so many rows of least
    hash of a (class, grade, fold) can be kept anywhere; the others leave before rows are
    expanded into cells."""
    h = hash_number(F.concat_ws(":", F.lit(str(seed)), F.col("index").cast("string")))
    order = [F.col("h"), F.col("index")]
    own = Window.partitionBy("label", "minority_type", "fold").orderBy(*order)
    some = ids.withColumn("h", h).withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= most).drop("rn")
    each = join_small(_training_ids(some, num_splits), counts.select(*CELL, "label", "min_n"), [*CELL, "label"])
    cell = Window.partitionBy(*CELL, "label").orderBy(*order)
    return each.withColumn("rn", F.row_number().over(cell)).where(F.col("rn") <= F.col("min_n")).select(*CELL, "index")


def _numbered(ids: DataFrame, need: DataFrame, num_splits: int) -> DataFrame:
    """``fold, subset_id, label, pos, index`` of the classes in need: a row's place in its class in a cell."""
    each = join_small(_training_ids(ids, num_splits), need.select(*CELL, "label"), [*CELL, "label"])
    return dense_positions(each.select(*CELL, "label", "index"), "index", [*CELL, "label"])


def copy_counts(numbered: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """``fold, subset_id, n_index, copies``: how often oversampling draws a row in a cell (R2).

    Draws are counted by place before they meet the rows, so a small class that is drawn from
    very often is no hot key."""
    need = counts.where("n < max_n").select(*CELL, "label", "n", (F.col("max_n") - F.col("n")).alias("m"))
    drawn = draw_table(need).groupBy(*CELL, "label", draw_position(F.col("n"), seed, "label", "s").alias("pos")) \
        .agg(F.count(F.lit(1)).alias("copies"))
    return join_rows(drawn, numbered, [*CELL, "label", "pos"]).select(*CELL, F.col("index").alias("n_index"), "copies")


def synthetic_rows(numbered: DataFrame, folded: DataFrame, counts: DataFrame, seed: int, draws_per_row: int = 5) -> DataFrame:
    """``fold, subset_id, label, draw, features``: the SMOTE rows of every cell."""
    target = F.floor(F.col("max_n") / 2)
    need = counts.where(F.col("n") < target).select(*CELL, "label", "n", (target - F.col("n")).alias("m"))
    places = F.array(*[draw_position(F.col("n"), seed, "label", "s", F.lit(j)) for j in range(1, draws_per_row + 1)])
    hit = draw_table(need).select(*CELL, "label", "s", F.explode(F.array_distinct(places)).alias("pos"))
    rows = join_rows(hit, numbered, [*CELL, "label", "pos"]).join(folded.select("index", "features"), "index")
    made = rows.groupBy(*CELL, "label", "s").agg(F.array_sort(F.collect_list(F.struct("pos", "features"))).alias("hit"))
    return made.select(*CELL, "label", F.col("s").cast("long").alias("draw"),
                       mean_of_arrays(F.transform("hit", lambda x: x["features"])).alias("features"))


def _searched(folded: DataFrame, parts: list[DataFrame], k: int, num_splits: int) -> DataFrame:
    """``part, index, subset_id, near``: the k nearest rows of each part's cells.

    ``parts``: rows ``fold, subset_id, n_index, label, features, draw``."""
    n_parts = len(parts)
    data = reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    per_fold = n_parts * N_SUBSETS
    cell = F.col("fold") * per_fold + F.col("part") * N_SUBSETS + F.col("subset_id")
    data = data.select(F.col("n_index").alias("index"), "label", "features", cell.cast("int").alias("cell"), "draw")
    query = folded.select("index", "label", "features", F.sequence(F.col("fold") * per_fold, (F.col("fold") + 1) * per_fold - 1).alias("probes"))
    nb = blocked_neighbours(query, data, k, exclude_self=False, per_cell=True, keep_draw=True, max_cells=num_splits * per_fold)
    entry = F.struct("d2", (F.col("n_draw") > 0).alias("made"), "n_index", F.col("n_draw").alias("draw"), "n_label")
    at = F.col("cell") % per_fold
    return nb.groupBy("index", F.floor(at / N_SUBSETS).cast("int").alias("part"), (at % N_SUBSETS).cast("int").alias("subset_id")) \
        .agg(F.sort_array(F.collect_list(entry)).alias("found"))


def _votes(rows: DataFrame, near: Column | str) -> DataFrame:
    near = F.col(near) if isinstance(near, str) else near
    return rows.where(F.size(near) > 0).select(
        "fold", "method_id", "subset_id", "label", majority(F.transform(near, lambda c: c["n_label"])).alias("prediction"))


def vote_grid_metrics(minority: DataFrame, methods: Sequence[str] = METHODS, k: int = 5, num_splits: int = 5,
                      seed: int = 42) -> DataFrame:
    """V3+V5+V6 with the kNN-vote stand-in model (L2): the ten metrics of every
    (fold, grade subset, method) cell; an empty cell has ``status`` empty_class.

    Returns ``fold, index, sampling, minority_types, subset_id`` + metrics +
    ``n_classes_scored``; ``index`` numbers the cells of a fold in method-then-subset order
    (V6). At equal distance an original row comes before a synthetic one, then the smaller id
    (for synthetic rows the label), then the earlier draw.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown sampling methods {sorted(unknown)}; use some of {METHODS}")
    spark = minority.sparkSession
    folded = reliable_checkpoint(assign_folds(minority, num_splits).select("index", "label", "minority_type", "features", "fold"))
    lists = reliable_checkpoint(grade_lists(folded, k)) if set(methods) - {"undersample"} else None
    ids = folded.select("index", "label", "minority_type", "fold")
    counts = reliable_checkpoint(training_counts(folded, num_splits))  # folds x subsets x classes
    numbered = None
    if {"oversample", "smote"} & set(methods):
        numbered = reliable_checkpoint(_numbered(ids, counts.where("n < max_n"), num_splits), cache=False)
    plain = _per_subset(lists, k) if lists is not None else None

    parts, part_of = [], {}
    if "undersample" in methods:
        most = counts.agg(F.max("min_n")).first()[0] or 0
        kept = kept_ids(ids, counts, most, num_splits, seed)
        part_of["undersample"] = len(parts)
        parts.append(kept.join(folded.select("index", "label", "features"), "index").select(
            *CELL, F.col("index").alias("n_index"), "label", "features", F.lit(0).cast("long").alias("draw")))
    if "smote" in methods:
        part_of["smote"] = len(parts)
        parts.append(synthetic_rows(numbered, folded, counts, seed).select(
            *CELL, F.col("label").cast("long").alias("n_index"), "label", "features", "draw"))
    found = reliable_checkpoint(_searched(folded, parts, k, num_splits)) if parts else None

    def votes(method: str, number: int) -> DataFrame:
        if method == "none":
            rows = plain
        elif method == "oversample":
            each = plain.select("*", F.explode("near").alias("c")).withColumn("n_index", F.col("c.n_index"))
            each = join_rows(each, copy_counts(numbered, counts, seed), [*CELL, "n_index"], "left")
            times = F.least(F.coalesce("copies", F.lit(0)) + 1, F.lit(k)).cast("int")
            rows = each.groupBy("index", "label", *CELL).agg(F.sort_array(F.collect_list(F.struct("c", times.alias("times")))).alias("l")) \
                .withColumn("near", F.slice(F.flatten(F.transform("l", lambda x: F.array_repeat(x["c"], x["times"]))), 1, k))
        else:
            mine = found.where(F.col("part") == part_of[method]).drop("part")
            if method == "undersample":
                rows = folded.select("index", "label", "fold").join(mine, "index").withColumnRenamed("found", "near")
            else:
                rows = plain.join(mine, ["index", "subset_id"], "left").withColumn(
                    "near", F.when(F.col("found").isNull(), F.col("near")).otherwise(
                        F.slice(F.sort_array(F.concat("near", "found")), 1, k)))
        return _votes(rows.withColumn("method_id", F.lit(number)), "near")

    per_fold = N_SUBSETS * len(methods)
    cell = F.col("fold") * per_fold + F.col("method_id") * N_SUBSETS + F.col("subset_id")

    def counted(method: str, number: int) -> DataFrame:
        """A method's confusion counts, written out: its plan is done before the next one's begins."""
        pred = votes(method, number).select(cell.cast("int").alias("cell"), "label", "prediction")
        return reliable_checkpoint(confusion(pred, ["cell"]), cache=False)

    conf = reduce(lambda a, b: a.unionByName(b), [counted(m, i) for i, m in enumerate(methods)])
    met = metrics(class_rates(conf, ["cell"]), ["cell"])
    names = F.array(*[F.lit(m) for m in methods])
    # the whole grid: num_splits x methods x 15 rows; a cell without training or test rows
    # keeps its number and says so
    grid = (spark.range(num_splits * per_fold).select(F.col("id").cast("int").alias("cell"))
            .withColumn("fold", F.floor(F.col("cell") / per_fold).cast("int"))
            .withColumn("index", (F.col("cell") % per_fold).cast("int"))
            .withColumn("subset_id", (F.col("index") % N_SUBSETS).cast("int")))
    sub = subsets_table(spark).select("subset_id", "subset")
    # both sides have a row per cell at most
    out = grid.join(F.broadcast(sub), "subset_id").join(F.broadcast(met), "cell", "left")
    return out.select(
        "fold", "index", F.element_at(names, F.floor(F.col("index") / N_SUBSETS).cast("int") + 1).alias("sampling"),
        F.col("subset").alias("minority_types"), "subset_id",
        *[F.round(m, 6).alias(m) for m in METRIC_NAMES], "n_classes_scored",
        F.when(F.col("n_classes_scored").isNull(), "empty_class").otherwise("ok").alias("status"))
