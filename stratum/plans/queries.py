"""Registered queries: one per operator group of the inventory, each reading the given
tables at ``sf_dir``; ``ORACLE`` holds the DuckDB SQL for the value-checked ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import grading as G
from stratum.operators import knn as K
from stratum.operators import resample as R
from stratum.operators.aggregates import class_counts, class_targets, feature_columns
from stratum.operators.cell_tree import knn_tree
from stratum.operators.class_search import average_distance_bounded, nearest_same_class_bounded
from stratum.operators.prepare import dictionary, impute_median, label_names, string_index
from stratum.operators.subsets import filter_all_subsets, subsets_table
from stratum.plans import oracle as O
from stratum.plans.grading import graded, scaled_points
from stratum.session import reliable_checkpoint
from stratum.sources import datasets as D
from stratum.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _doc_scaled(spark, sf):
    return scaled_points(D.ds_doc(spark, sf))


def _doc_graded(spark, sf, k=5, persist=True):
    """The graded table; a report that reads it once asks for no checkpoint."""
    return graded(D.ds_doc(spark, sf), k, persist=persist)


# ----------------------------------------------------------------- grading (flagship)

@query("minority_counts",
       O.doc_graded_prefix(5) + " SELECT label, minority_type, count(*) AS n FROM g"
       " GROUP BY label, minority_type")
def minority_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents -> scale -> exact 5-NN -> grade ->
    rows per (class, grade)."""
    return G.type_report(_doc_graded(spark, sf, persist=False))


@query("minority_types",
       O.doc_graded_prefix(5) + ' SELECT idx AS "index", label, minority_type FROM g')
def minority_types_q(spark, sf):
    """M3/M4/M5: the grade of every row, k=5."""
    return _doc_graded(spark, sf, persist=False).select("index", "label", "minority_type")


@query("minority_types_k10",
       O.doc_graded_prefix(10) + ' SELECT idx AS "index", label, minority_type FROM g')
def minority_types_k10(spark, sf):
    """M1 for general k: grades at k=10."""
    return _doc_graded(spark, sf, 10, persist=False).select("index", "label", "minority_type")


_B, _ = O.ds_sql("DS_DOC")


@query("min_max_scale",
       f"WITH ds AS ({_B}), {O.scaled_sql('ds', 4)} SELECT idx AS \"index\", label,"
       f" {O.round_cols(4)} FROM sc")
def min_max_scale_q(spark, sf):
    """Min-max scaled features (constant feature -> 0.5)."""
    return feature_columns(_doc_scaled(spark, sf), 4, keep=("index", "label"))


@query("knn_exact",
       f"WITH ds AS ({_B}), {O.scaled_sql('ds', 4)}, {O.knn_sql('sc', 4, 5)}"
       " SELECT idx AS \"index\", n_idx AS n_index, CAST(rn AS INTEGER) AS rn,"
       " round(d2, 6) AS d2 FROM nn")
def knn_exact(spark, sf):
    """K1-K3: exact 5 nearest neighbours of every scaled document row."""
    nb = K.knn(_doc_scaled(spark, sf), 5)
    return nb.select("index", "n_index", F.col("rn").cast("int").alias("rn"),
                     F.round("d2", 6).alias("d2"))


_E, _ = O.ds_sql("DS_EMB")


@query("knn_exact_vectors",
       f"WITH ds AS ({_E}), {O.knn_sql('ds', 64, 5)}"
       " SELECT idx AS \"index\", n_idx AS n_index, CAST(rn AS INTEGER) AS rn,"
       " round(d2, 6) AS d2 FROM nn")
def knn_exact_vectors(spark, sf):
    """K3 on 64-d embeddings (unscaled)."""
    nb = K.knn(D.ds_emb(spark, sf), 5)
    return nb.select("index", "n_index", F.col("rn").cast("int").alias("rn"),
                     F.round("d2", 6).alias("d2"))


@query("nearest_same_class",
       f"WITH ds AS ({_B}), {O.scaled_sql('ds', 4)} SELECT a.idx AS \"index\", a.label,"
       f" round(sqrt(min({O.d2_sql(4)})), 6) AS distance FROM sc a LEFT JOIN sc b"
       " ON a.label = b.label AND a.idx <> b.idx GROUP BY a.idx, a.label")
def nearest_same_class(spark, sf):
    """K5: distance to the nearest other row of the same class."""
    d = K.nearest_same_class_distance(_doc_scaled(spark, sf))
    return d.select("index", "label", F.round("distance", 6).alias("distance"))


@query("average_distance",
       f"WITH ds AS ({_B}), {O.scaled_sql('ds', 4)} SELECT a.idx AS \"index\", a.label,"
       f" round(CASE WHEN count(*) > 1 THEN sum(sqrt({O.d2_sql(4)})) / (count(*) - 1) END, 6)"
       " AS avg_distance FROM sc a JOIN sc b ON a.label = b.label GROUP BY a.idx, a.label")
def average_distance(spark, sf):
    """K6: average distance of a row to the rest of its class."""
    d = K.average_distance(_doc_scaled(spark, sf))
    return d.select("index", "label", F.round("avg_distance", 6).alias("avg_distance"))


@query("neighbour_match_vector",
       f"WITH ds AS ({_B}), {O.scaled_sql('ds', 4)}, {O.knn_sql('sc', 4, 5)}"
       " SELECT idx AS \"index\", label, string_agg(CAST(CASE WHEN n_label = label THEN 1"
       " ELSE 0 END AS VARCHAR), ',' ORDER BY rn) AS matches FROM nn GROUP BY idx, label")
def neighbour_match_vector(spark, sf):
    """K7: per row, which of its 5 neighbours share its class, in neighbour order."""
    v = K.neighbour_match_vector(K.knn(_doc_scaled(spark, sf), 5))
    return v.select("index", "label",
                    F.array_join(F.transform("matches", lambda m: m.cast("string")), ",")
                    .alias("matches"))


@query("one_vs_rest_report",
       O.doc_graded_prefix(5) + ", cls AS (SELECT DISTINCT label AS c FROM sc),"
       " pc AS (SELECT idx, n_label, count(*) AS cnt FROM nn GROUP BY idx, n_label),"
       " tot AS (SELECT idx, count(*) AS tn FROM nn GROUP BY idx),"
       " ovr AS (SELECT cls.c, CAST(s.label = cls.c AS INTEGER) AS pos,"
       " CASE WHEN s.label = cls.c THEN coalesce(pc.cnt, 0)"
       " ELSE coalesce(tot.tn, 0) - coalesce(pc.cnt, 0) END AS hits"
       " FROM sc s CROSS JOIN cls LEFT JOIN pc ON pc.idx = s.idx AND pc.n_label = cls.c"
       " LEFT JOIN tot ON tot.idx = s.idx),"
       f" og AS (SELECT c, pos, {O.grade_case('hits', 5)} AS gr FROM ovr)"
       " SELECT CAST(c AS INTEGER) AS class, pos AS is_positive, count(*) AS n,"
       " count(*) FILTER (WHERE gr = 0) AS safe, count(*) FILTER (WHERE gr = 1) AS borderline,"
       " count(*) FILTER (WHERE gr = 2) AS rare, count(*) FILTER (WHERE gr = 3) AS outlier"
       " FROM og GROUP BY c, pos")
def one_vs_rest_report(spark, sf):
    """M6+M7: per class, positive/negative totals and grade counts in the one-vs-rest view."""
    pts = _doc_scaled(spark, sf)
    return G.one_vs_rest_totals(pts, K.knn(pts, 5), 5)


_SUBSET_TEXT = ("'[' || concat_ws(' ', CASE WHEN (i & 1) = 0 THEN '0' END,"
                " CASE WHEN (i & 2) = 0 THEN '1' END, CASE WHEN (i & 4) = 0 THEN '2' END,"
                " CASE WHEN (i & 8) = 0 THEN '3' END) || ']'")


@query("type_subsets",
       O.doc_graded_prefix(5) + f", ss AS (SELECT CAST(i AS INTEGER) AS subset_id,"
       f" {_SUBSET_TEXT} AS subset FROM range(15) t(i))"
       " SELECT ss.subset_id, ss.subset, g.label, count(*) AS n FROM ss JOIN g"
       " ON ((ss.subset_id >> g.minority_type) & 1) = 0 GROUP BY ss.subset_id, ss.subset, g.label")
def type_subsets(spark, sf):
    """rows kept per (grade subset, class) for all 15 subsets in one pass."""
    g = filter_all_subsets(_doc_graded(spark, sf))
    cnt = g.groupBy("subset_id", "label").agg(F.count(F.lit(1)).alias("n"))
    names = subsets_table(spark).select("subset_id", "subset")
    return cnt.join(F.broadcast(names), "subset_id")  # 15 rows


@query("filter_by_subset_counts",
       O.doc_graded_prefix(5) + f", ss AS (SELECT CAST(i AS INTEGER) AS subset_id,"
       f" {_SUBSET_TEXT} AS subset FROM range(15) t(i))"
       " SELECT ss.subset_id, ss.subset, count(g.idx) AS n FROM ss LEFT JOIN g"
       " ON ((ss.subset_id >> g.minority_type) & 1) = 0 GROUP BY ss.subset_id, ss.subset")
def filter_by_subset_counts(spark, sf):
    """rows kept by each grade subset."""
    g = filter_all_subsets(_doc_graded(spark, sf))
    cnt = g.groupBy("subset_id").agg(F.count(F.lit(1)).alias("n"))
    names = subsets_table(spark).select("subset_id", "subset")
    # both sides have a row per subset at most, that is 15
    return names.join(F.broadcast(cnt), "subset_id", "left").fillna(0, subset=["n"])


# ----------------------------------------------------------------- counts, targets, dictionaries

_L, _ = O.ds_sql("DS_LANG")
_ORD, _ = O.ds_sql("DS_ORD")


@query("class_counts", f"WITH ds AS ({_L}) SELECT label, count(*) AS n FROM ds GROUP BY label")
def class_counts_q(spark, sf):
    """Rows per class."""
    return class_counts(D.ds_lang(spark, sf))


@query("class_targets",
       f"WITH ds AS ({_ORD}), c AS (SELECT label, count(*) AS n FROM ds GROUP BY label)"
       " SELECT count(*) AS n_classes, min(n) AS min_n, max(n) AS max_n, min(n) AS under_target,"
       " max(n) AS over_target, CAST(max(n) // 2 AS BIGINT) AS smote_target FROM c")
def class_targets_q(spark, sf):
    """A2: class count, min/max class size and the three resampling targets."""
    return class_targets(class_counts(D.ds_ord(spark, sf)))


@query("string_index",
       "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),"
       " r AS (SELECT lang, CAST(row_number() OVER (ORDER BY n DESC, lang) - 1 AS INTEGER)"
       " AS lang_idx FROM c) SELECT d.doc_id, r.lang_idx FROM documents d JOIN r ON d.lang = r.lang")
def string_index_q(spark, sf):
    """Frequency-ranked index of a string column."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return string_index(docs, ["lang"]).select("doc_id", "lang_idx")


@query("index_to_name",
       "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),"
       " r AS (SELECT lang, CAST(row_number() OVER (ORDER BY n DESC, lang) - 1 AS INTEGER)"
       " AS label FROM c) SELECT r.label, r.lang AS name, c.n FROM r JOIN c ON r.lang = c.lang")
def index_to_name(spark, sf):
    """Indexed label -> original name, with the class size."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    idx = string_index(docs, ["lang"], drop=False)
    cnt = idx.groupBy(F.col("lang_idx").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return label_names(cnt, dictionary(docs, "lang")).select("label", "name", "n")


# ----------------------------------------------------------------- resampling

_OV = (f"WITH ds AS ({_L}), cnt AS (SELECT label, count(*) AS n FROM ds GROUP BY label),"
       " tg AS (SELECT label, n, max(n) OVER () - n AS m FROM cnt),"
       " dr AS (SELECT label, n, unnest(generate_series(1, m)) AS s FROM tg WHERE m > 0 AND n > 0),"
       " num AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos"
       " FROM ds),"
       f" cp AS (SELECT num.idx, num.label FROM dr JOIN num ON dr.label = num.label"
       f" AND num.pos = {O.draw_sql('dr.n', 'dr.label', 'dr.s')}),"
       " allr AS (SELECT idx, label FROM ds UNION ALL SELECT idx, label FROM cp)"
       ' SELECT label, idx AS "index", count(*) AS copies FROM allr GROUP BY label, idx')


@query("oversample", _OV)
def oversample_q(spark, sf):
    """R2: exact, seeded oversampling to the largest class; copies per original row."""
    r = R.oversample(D.ds_lang(spark, sf))
    return r.groupBy("label", "index").agg(F.count(F.lit(1)).alias("copies"))


_UN = (f"WITH ds AS ({_L}), h AS (SELECT idx, label, CAST(('0x' || substr(md5('{O.SEED}' || ':'"
       " || CAST(idx AS VARCHAR)), 1, 15)) AS BIGINT) AS hv FROM ds),"
       " r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY hv, idx) AS rn"
       " FROM h), mn AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM ds GROUP BY label))"
       ' SELECT idx AS "index", label FROM r, mn WHERE rn <= mn.m')


@query("undersample", _UN)
def undersample_q(spark, sf):
    """Exact, seeded undersampling to the smallest class."""
    return R.undersample(D.ds_lang(spark, sf)).select("index", "label")


def _smote_sql(types: tuple[int, ...] | None) -> str:
    where = "" if types is None else f" WHERE minority_type IN ({', '.join(map(str, types))})"
    avgs = ", ".join(f"avg(num.f{i}) AS f{i}" for i in range(4))
    return (O.doc_graded_prefix(5) + f", gf AS (SELECT * FROM g{where}),"
            " cnt AS (SELECT label, count(*) AS n FROM gf GROUP BY label),"
            " tg AS (SELECT label, n, (max(n) OVER ()) // 2 - n AS m FROM cnt),"
            " dr AS (SELECT label, n, unnest(generate_series(1, m)) AS s FROM tg WHERE m > 0),"
            " dj AS (SELECT label, n, s, unnest(generate_series(1, 5)) AS j FROM dr),"
            f" hit AS (SELECT DISTINCT label, s, {O.draw_sql('n', 'label', 's', 'j')} AS pos"
            " FROM dj),"
            " num AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos"
            " FROM gf),"
            f" syn AS (SELECT hit.label, hit.s, {avgs} FROM hit JOIN num ON hit.label = num.label"
            " AND hit.pos = num.pos GROUP BY hit.label, hit.s)"
            f" SELECT label, CAST(s AS BIGINT) AS draw, {O.round_cols(4)} FROM syn")


def _smote_rows_out(df):
    syn = R.smote_rows(df)
    return feature_columns(syn, 4, keep=("label", "draw"))


@query("smote", _smote_sql(None))
def smote_q(spark, sf):
    """SMOTE (mean of distinct drawn rows) synthetic rows over the graded table."""
    return _smote_rows_out(_doc_graded(spark, sf))


@query("smote_filtered", _smote_sql((1, 2, 3)))
def smote_filtered_q(spark, sf):
    """R9+F2: grades [1 2 3] kept, then SMOTE; targets computed after the filter."""
    made = R.resample_types(_doc_graded(spark, sf), (1, 2, 3), "smote").where("is_synthetic")
    return feature_columns(made, 4, keep=("label", "draw"))


# ----------------------------------------------------------------- folds, confusion, metrics

from stratum.operators.folds import assign_folds  # noqa: E402
from stratum.operators.metrics import METRIC_NAMES, class_rates, confusion, confusion_wide, metrics  # noqa: E402
from stratum.operators.model import fold_vote_predict  # noqa: E402


def _graded_folds(spark, sf):
    return assign_folds(_doc_graded(spark, sf), 5)


@query("fold_cuts",
       O.doc_graded_prefix(5) + ", " + O.fold_sql("g") +
       ' SELECT fold, count(*) AS n, min(idx) AS min_index, max(idx) AS max_index FROM fo'
       ' GROUP BY fold')
def fold_cuts(spark, sf):
    """P2+V1: five contiguous folds by row rank; size, first and last id of each."""
    f = _graded_folds(spark, sf)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("min_index"),
                                 F.max("index").alias("max_index"))


@query("fold_sizes",
       O.doc_graded_prefix(5) + ", " + O.fold_sql("g") +
       ", fl AS (SELECT CAST(i AS INTEGER) AS f FROM range(5) t(i))"
       " SELECT fl.f AS fold, fo.label, count(*) FILTER (WHERE fo.fold <> fl.f) AS n_train,"
       " count(*) FILTER (WHERE fo.fold = fl.f) AS n_test FROM fl CROSS JOIN fo"
       " GROUP BY fl.f, fo.label")
def fold_sizes(spark, sf):
    """V2: per fold and class, train rows (other folds) and test rows (this fold)."""
    f = _graded_folds(spark, sf)
    per = f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("c"))
    tot = per.groupBy("label").agg(F.sum("c").alias("t"))
    # every (fold, label) pair: the five fold ids are a literal array, exploded per class
    grid = tot.select("label", "t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    j = grid.join(per, ["fold", "label"], "left").fillna(0, subset=["c"])
    return j.select("fold", "label", (F.col("t") - F.col("c")).cast("long").alias("n_train"),
                    F.col("c").cast("long").alias("n_test"))


def _fold_votes(spark, sf):
    """L2 predictions: every fold's rows predicted by 5-NN vote from the other folds, all
    folds in one blocked neighbour search."""
    return fold_vote_predict(reliable_checkpoint(_graded_folds(spark, sf)), 5)


_CONF = (O.doc_graded_prefix(5) + ", " + O.fold_sql("g") + ", " + O.vote_confusion_sql("fo", 4))


@query("confusion", _CONF + " SELECT fold, label, prediction, n FROM conf")
def confusion_q(spark, sf):
    """A5 (long form) with the kNN-vote stand-in model over five folds."""
    return confusion(_fold_votes(spark, sf), ["fold"])


@query("confusion_wide", _CONF + " SELECT label, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE prediction = {p}), 0) AS BIGINT) AS \"{p}\"" for p in range(4)) + " FROM conf GROUP BY label")
def confusion_wide_q(spark, sf):
    """A5 (wide form) and O2: a row per actual class, a column per predicted one, all folds together."""
    return confusion_wide(confusion(_fold_votes(spark, sf)), [0, 1, 2, 3])


@query("class_rates", _CONF + ", " + O.rates_sql() +
       " SELECT fold, label, tp, fn, fp, tn FROM rates")
def class_rates_q(spark, sf):
    """Tp / fn / fp / tn per fold and class."""
    r = class_rates(confusion(_fold_votes(spark, sf), ["fold"]), ["fold"])
    return r.drop("has_test")


@query("multiclass_metrics", _CONF + ", " + O.rates_sql() + ", " + O.metrics_sql() +
       f" SELECT fold, {O.round_metrics()}, n_classes_scored FROM met")
def multiclass_metrics(spark, sf):
    """The ten metrics per fold."""
    m = metrics(class_rates(confusion(_fold_votes(spark, sf), ["fold"]), ["fold"]), ["fold"])
    return m.select("fold", *[F.round(c, 6).alias(c) for c in METRIC_NAMES], "n_classes_scored")


# ----------------------------------------------------------------- clusters, SMOTE+

from stratum.operators.aggregates import cluster_histogram  # noqa: E402
from stratum.operators.subsets import cluster_keep, empty_classes, select_by_clusters  # noqa: E402

FIXED_K = 3


def _fixed_clusters(spark, sf):
    g = _doc_graded(spark, sf)
    return g.withColumn("cluster", F.pmod(F.col("index"), F.lit(FIXED_K)).cast("int"))


_CL = O.doc_graded_prefix(5) + f", cl AS (SELECT *, CAST(idx % {FIXED_K} AS INTEGER) AS cluster FROM g)"


@query("cluster_histogram", _CL + " SELECT label, cluster, minority_type, count(*) AS n FROM cl"
       " GROUP BY label, cluster, minority_type")
def cluster_histogram_q(spark, sf):
    """Grade histogram per (class, cluster); cluster = index mod 3 (fixed)."""
    return cluster_histogram(_fixed_clusters(spark, sf))


@query("cluster_cutoff", _CL + " SELECT label, cluster, count(*) AS n,"
       " count(*) FILTER (WHERE minority_type IN (1, 2, 3)) AS n_selected,"
       " count(*) FILTER (WHERE minority_type IN (1, 2, 3)) >= count(*) * 0.5 AS keep"
       " FROM cl GROUP BY label, cluster")
def cluster_cutoff_q(spark, sf):
    """which clusters survive a 0.5 cutoff for grades [1 2 3]."""
    return cluster_keep(_fixed_clusters(spark, sf), [1, 2, 3], 0.5)


@query("empty_class_report",
       O.doc_graded_prefix(5) + f", ss AS (SELECT CAST(i AS INTEGER) AS subset_id FROM range(15) t(i)),"
       " cls AS (SELECT DISTINCT label FROM g)"
       " SELECT ss.subset_id, cls.label, 'empty_class' AS status FROM ss CROSS JOIN cls"
       " WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.label = cls.label"
       " AND ((ss.subset_id >> g.minority_type) & 1) = 0)")
def empty_class_report(spark, sf):
    """(subset, class) pairs where the grade filter leaves the class empty."""
    return empty_classes(_doc_graded(spark, sf))


def _smote_plus_sql(k: int) -> str:
    avgs = ", ".join(f"avg(num.f{i}) AS f{i}" for i in range(4))
    return (_CL + ", cnt AS (SELECT label, count(*) AS n FROM cl GROUP BY label),"
            " tg AS (SELECT label, (max(n) OVER ()) // 2 - n AS m FROM cnt),"
            " sz AS (SELECT label, cluster, count(*) AS size FROM cl GROUP BY label, cluster),"
            " rk AS (SELECT label, cluster, size, dense_rank() OVER (PARTITION BY label ORDER BY"
            " cluster) - 1 AS crank, count(*) OVER (PARTITION BY label) AS ncl FROM sz),"
            " nc AS (SELECT DISTINCT label, ncl FROM rk),"
            " dr AS (SELECT tg.label, nc.ncl, unnest(generate_series(1, tg.m)) AS s FROM tg"
            " JOIN nc ON tg.label = nc.label WHERE tg.m > 0),"
            " pk AS (SELECT dr.label, dr.s, rk.cluster, rk.size FROM dr JOIN rk"
            f" ON rk.label = dr.label AND rk.crank = {O.draw_sql('dr.ncl', 'dr.label', 'dr.s')}),"
            f" dj AS (SELECT label, s, cluster, size, unnest(generate_series(1, {k})) AS j FROM pk),"
            " num AS (SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY idx) - 1"
            " AS pos FROM cl),"
            f" syn AS (SELECT dj.label, dj.s, {avgs} FROM dj JOIN num ON num.label = dj.label"
            " AND num.cluster = dj.cluster AND num.pos ="
            f" {O.draw_sql('dj.size', 'dj.label', 'dj.s', 'dj.j')} GROUP BY dj.label, dj.s)"
            f" SELECT label, CAST(s AS BIGINT) AS draw, {O.round_cols(4)} FROM syn")


@query("smote_plus_fixed", _smote_plus_sql(FIXED_K))
def smote_plus_fixed(spark, sf):
    """SMOTE+ synthetic rows with a fixed cluster column (index mod 3): pick a
    cluster of the class uniformly, average 3 draws with replacement from it."""
    cl = _fixed_clusters(spark, sf)
    sel = select_by_clusters(cl, [0, 1, 2, 3], 0.0)
    syn = R.smote_plus_rows(sel, cl, FIXED_K)
    return feature_columns(syn, 4, keep=("label", "draw"))


# ----------------------------------------------------------------- neighbour search at scale (K4)

@query("knn_cells_full",
       f"WITH ds AS ({_E}), {O.knn_sql('ds', 64, 5)}"
       " SELECT idx AS \"index\", n_idx AS n_index, CAST(rn AS INTEGER) AS rn,"
       " round(d2, 6) AS d2 FROM nn")
def knn_cells_full(spark, sf):
    """K4 at full probe (8 k-means cells, all probed): equal to the exact search."""
    nb = K.knn_cells(D.ds_emb(spark, sf), 5, n_cells=8, nprobe=8)
    return nb.select("index", "n_index", F.col("rn").cast("int").alias("rn"),
                     F.round("d2", 6).alias("d2"))


@query("knn_exact_pruned",
       f"WITH ds AS ({_E}), {O.knn_sql('ds', 64, 5)}"
       " SELECT idx AS \"index\", n_idx AS n_index, CAST(rn AS INTEGER) AS rn,"
       " round(d2, 6) AS d2 FROM nn")
def knn_exact_pruned(spark, sf):
    """K3 by cells with radii (16 k-means cells): equal to the all-pairs search."""
    nb = K.knn_pruned(D.ds_emb(spark, sf), 5, n_cells=16)
    return nb.select("index", "n_index", F.col("rn").cast("int").alias("rn"),
                     F.round("d2", 6).alias("d2"))


@query("knn_cells")
def knn_cells_q(spark, sf):
    """K4: 16 cells in four groups, probed as deep as a measured recall of 0.9 asks
    (approximate; rows-only check, ``knn_cells_recall`` checks the recall)."""
    nb = knn_tree(D.ds_emb(spark, sf), 5, n_cells=16)
    return nb.select("index", "n_index", F.col("rn").cast("int").alias("rn"),
                     F.round("d2", 6).alias("d2"))


# ----------------------------------------------------------------- grid, models, clusters

from functools import reduce  # noqa: E402

from stratum.operators.clusters import class_clusters  # noqa: E402
from stratum.operators.metrics import METRIC_NAMES  # noqa: E402
from stratum.operators.subsets import filter_all_subsets as _fas  # noqa: E402
from stratum.plans.experiment import run_experiment  # noqa: E402

_GRID_METHODS = ("none", "undersample", "oversample", "smote")


@query("grid_counts",
       O.doc_graded_prefix(5) + ", " + O.fold_sql("g") +
       ", fl AS (SELECT CAST(i AS INTEGER) AS f FROM range(5) t(i)),"
       " ss AS (SELECT CAST(i AS INTEGER) AS subset_id FROM range(15) t(i)),"
       " tr AS (SELECT fl.f AS fold, ss.subset_id, fo.label FROM fl CROSS JOIN ss JOIN fo"
       " ON fo.fold <> fl.f AND ((ss.subset_id >> fo.minority_type) & 1) = 0),"
       " c AS (SELECT fold, subset_id, label, count(*) AS n FROM tr GROUP BY fold, subset_id, label),"
       " t AS (SELECT *, min(n) OVER (PARTITION BY fold, subset_id) AS mn,"
       " max(n) OVER (PARTITION BY fold, subset_id) AS mx FROM c),"
       " m AS (SELECT * FROM (VALUES ('none'), ('undersample'), ('oversample'), ('smote')) v(method))"
       " SELECT fold, subset_id, method, label, CAST(CASE method WHEN 'none' THEN n"
       " WHEN 'undersample' THEN mn WHEN 'oversample' THEN mx ELSE greatest(n, mx // 2) END"
       " AS BIGINT) AS n, CAST(CASE method WHEN 'oversample' THEN mx - n WHEN 'smote' THEN"
       " greatest(mx // 2 - n, 0) ELSE 0 END AS BIGINT) AS n_added FROM t CROSS JOIN m")
def grid_counts(spark, sf):
    """Training-set sizes of every (fold, grade subset, method) cell, all
    cells of a method resampled in one plan keyed by (fold, subset)."""
    # written once: every method reads the rows, their counts and their places
    f = reliable_checkpoint(_graded_folds(spark, sf), cache=False)
    train = f.withColumn("cell_fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)),
                                                         lambda x: x != F.col("fold"))))
    train = _fas(train.drop("fold").withColumnRenamed("cell_fold", "fold"))

    def sizes(method: str) -> DataFrame:
        """A row per cell and class, staged: one plan a method, not all methods in one."""
        rows = R.resample(train, method, keys=["fold", "subset_id"]).withColumn("method", F.lit(method))
        return reliable_checkpoint(rows.groupBy("fold", "subset_id", "method", "label").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("draw").isNotNull()).alias("n_added")), cache=False)

    return reduce(lambda a, b: a.unionByName(b), [sizes(m) for m in _GRID_METHODS])


_GRID_ROWS = ("fold", "index", "sampling", "minority_types", "clusters", "cutoff", "n_train", "n_test",
              "status")


def _grid_report(res: DataFrame) -> DataFrame:
    """What does not depend on a model's fit: the cells, their sizes and status, and whether
    every metric of a scored cell lies in [0, 1]."""
    fine = [F.col(m).between(0.0, 1.0) for m in METRIC_NAMES]
    ok = F.when(F.col("status") == "ok", reduce(lambda a, b: a & b, fine))
    return res.select(*_GRID_ROWS, F.coalesce(ok, F.lit(True)).alias("metrics_in_range"))


def _model_grid_sql(cells: str, n_train: str, empty: str) -> str:
    """Cells of the 5-fold grid with their training and test rows. ``cells`` lists (position,
    method, clusters, cutoff); a cell's rows are 15 positions long per entry."""
    return (O.doc_graded_prefix(5) + ", " + O.fold_sql("g") +
            ", fl AS (SELECT CAST(i AS INTEGER) AS f FROM range(5) t(i)),"
            f" ss AS (SELECT CAST(i AS INTEGER) AS subset_id, {_SUBSET_TEXT} AS subset FROM range(15) t(i)),"
            " cl AS (SELECT DISTINCT fl.f AS fold, fo.label FROM fl JOIN fo ON fo.fold <> fl.f),"
            " c AS (SELECT fl.f AS fold, ss.subset_id, fo.label, count(*) AS n FROM fl CROSS JOIN ss JOIN fo"
            " ON fo.fold <> fl.f AND ((ss.subset_id >> fo.minority_type) & 1) = 0 GROUP BY ALL),"
            " t AS (SELECT *, min(n) OVER (PARTITION BY fold, subset_id) AS mn,"
            " max(n) OVER (PARTITION BY fold, subset_id) AS mx FROM c),"
            f" m(pos, method, clusters, cutoff) AS (VALUES {cells}),"
            f" s AS (SELECT m.pos, t.fold, t.subset_id, CAST(sum({n_train}) AS BIGINT) AS n_train,"
            " count(*) AS n_classes FROM t CROSS JOIN m GROUP BY ALL),"
            " k AS (SELECT fold, count(*) AS n_classes FROM cl GROUP BY fold),"
            " te AS (SELECT fl.f AS fold, count(fo.idx) AS n_test FROM fl LEFT JOIN fo ON fo.fold = fl.f GROUP BY fl.f),"
            f" x AS (SELECT fl.f AS fold, m.*, ss.*, CASE WHEN {empty} THEN NULL ELSE s.n_train END AS n_train"
            " FROM fl CROSS JOIN m CROSS JOIN ss JOIN k ON k.fold = fl.f"
            " LEFT JOIN s ON s.fold = fl.f AND s.pos = m.pos AND s.subset_id = ss.subset_id)"
            ' SELECT x.fold, CAST(pos * 15 + subset_id AS INTEGER) AS "index", method AS sampling,'
            " subset AS minority_types, clusters, cutoff, n_train, te.n_test,"
            " CASE WHEN n_train IS NULL THEN 'empty_class' ELSE 'ok' END AS status, true AS metrics_in_range"
            " FROM x JOIN te ON te.fold = x.fold")


_FOREST_CELLS = ", ".join(f"({i}, '{m}', CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE))"
                          for i, m in enumerate(_GRID_METHODS))
_CLUSTER_KS = (2, 5, 10, 25, 50)
_PLUS_CELLS = ", ".join(f"({i}, 'smotePlus', {k}, CAST(0.0 AS DOUBLE))" for i, k in enumerate(_CLUSTER_KS))


@query("random_forest_grid",
       _model_grid_sql(_FOREST_CELLS, "CASE method WHEN 'none' THEN n WHEN 'undersample' THEN mn"
                       " WHEN 'oversample' THEN mx ELSE greatest(n, mx // 2) END", "s.n_train IS NULL"))
def random_forest_grid(spark, sf):
    """L1+V3+V5+V6: random forest (10 trees, seed 42) for every fold x grade subset x method,
    five folds; the cells, their sizes and status are checked, and that the metrics of every
    forest lie in [0, 1] (their values depend on the layout)."""
    return _grid_report(run_experiment(_doc_graded(spark, sf), methods=_GRID_METHODS, parallel_fits=8))


@query("smote_plus_grid",
       _model_grid_sql(_PLUS_CELLS, "greatest(n, mx // 2)", "s.n_train IS NULL OR s.n_classes < k.n_classes"))
def smote_plus_grid(spark, sf):
    """V4+C1+R5+F5+F6: SMOTE+ with per-class k-means for k in (2, 5, 10, 25, 50), cutoff 0,
    every grade subset, five folds; checked like ``random_forest_grid``."""
    return _grid_report(run_experiment(_doc_graded(spark, sf), methods=("smotePlus",),
                                       cluster_ks=_CLUSTER_KS, parallel_fits=8))


@query("smote_plus")
def smote_plus_q(spark, sf):
    """C1+R5+R8: per-class k-means (k=5, seed 1), then SMOTE+ synthetic rows."""
    g = _doc_graded(spark, sf)
    cl = class_clusters(g, 5)
    sel = select_by_clusters(cl, [0, 1, 2, 3], 0.0).drop("k_eff")
    syn = R.smote_plus_rows(sel, cl.select("label", "cluster", "index", "features"), 5)
    return feature_columns(syn, 4, keep=("label", "draw"))


@query("class_clusters_report",
       O.doc_graded_prefix(5) + ", ks AS (SELECT unnest([2, 5, 25]) AS k)"
       " SELECT label, CAST(k AS INTEGER) AS k, count(*) AS n, CAST(least(k, count(*)) AS INTEGER) AS k_eff,"
       " true AS nearest_centre FROM g CROSS JOIN ks GROUP BY label, k")
def class_clusters_report(spark, sf):
    """Rows, effective k, and whether every row lies in the cluster whose mean is nearest to it
    (a fixed point of k-means, up to the tolerance), for three ks at once."""
    from stratum.operators.clusters import keyed_clusters
    c = reliable_checkpoint(keyed_clusters(_doc_graded(spark, sf), (2, 5, 25), max_iter=100, tolerance=0.0))
    means = c.groupBy("label", "k", "cluster").agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(4)])
    means = means.groupBy("label", "k").agg(F.collect_list(F.struct(
        "cluster", F.array(*[F.col(f"m{i}") for i in range(4)]).alias("m"))).alias("means"))  # k at most
    far = F.transform("means", lambda x: F.struct(x["cluster"].alias("cluster"), squared_distance("features", x["m"]).alias("d")))
    own = F.array_max(F.transform(F.filter("far", lambda x: x["cluster"] == F.col("cluster")), lambda x: x["d"]))
    least = F.array_min(F.transform("far", lambda x: x["d"]))
    rows = c.join(means, ["label", "k"]).withColumn("far", far)
    return rows.groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"), F.max("k_eff").alias("k_eff"),
                                          F.bool_and((own <= least + 1e-9) & (F.col("cluster") < F.col("k_eff"))).alias("nearest_centre"))


# ----------------------------------------------------------------- sources and sinks

from stratum.sources import files as FS  # noqa: E402
from pyspark.sql import types as T  # noqa: E402


@query("csv_round_trip",
       f"WITH ds AS ({_B}) SELECT idx AS \"index\", label, {O.round_cols(4)} FROM ds")
def csv_round_trip(spark, sf):
    """S1+P1+P3: write the raw indexed table as header CSV, read it back with an explicit
    schema, pick the label by name and rebuild the feature array."""
    from stratum.operators.prepare import to_indexed
    raw = feature_columns(D.ds_doc(spark, sf), 4, digits=None, keep=("index", "label"))
    path = FS.scratch_path(spark, "csv-round-trip")
    raw.write.mode("overwrite").option("header", True).csv(path)
    schema = T.StructType([T.StructField("index", T.LongType()),
                           T.StructField("label", T.IntegerType())]
                          + [T.StructField(f"f{i}", T.DoubleType()) for i in range(4)])
    back = FS.read_table(spark, path, schema)
    idx = to_indexed(back, "label", [f"f{i}" for i in range(4)], index_col="index")
    return feature_columns(idx, 4, keep=("index", "label"))


@query("minority_round_trip",
       O.doc_graded_prefix(5) + f' SELECT idx AS "index", label, minority_type,'
       f' {O.round_cols(4)} FROM g')
def minority_round_trip(spark, sf):
    """S2+S3+S6+P4: compute the minority table in ``write`` mode (saved as CSV with
    ``"[a,b,c]"`` feature text), then load it again in ``read`` mode and parse."""
    path = FS.scratch_path(spark, "minority")
    FS.load_or_compute(spark, "write", path, lambda: _doc_graded(spark, sf))
    back = FS.load_or_compute(spark, "read", path, None)
    return feature_columns(back, 4, keep=("index", "label", "minority_type"))


# ----------------------------------------------------------------- grid metrics (V3, V5, V6)

from stratum.plans.vote_grid import vote_grid_metrics  # noqa: E402


def _vote_grid_sql() -> str:
    f = O.fcols(4)
    nf = O.fcols(4, "num.")
    avgs = ", ".join(f"avg(num.f{i}) AS f{i}" for i in range(4))
    hv = (f"CAST(('0x' || substr(md5('{O.SEED}' || ':' || CAST(idx AS VARCHAR)), 1, 15))"
          " AS BIGINT)")
    methods = "('none', 0), ('undersample', 1), ('oversample', 2), ('smote', 3)"
    return (O.doc_graded_prefix(5) + ", " + O.fold_sql("g") +
            ", fl AS (SELECT CAST(i AS INTEGER) AS f FROM range(5) t(i)),"
            f" ss AS (SELECT CAST(i AS INTEGER) AS subset_id, {_SUBSET_TEXT} AS subset"
            " FROM range(15) t(i)),"
            f" tr AS (SELECT fl.f AS fold, ss.subset_id, fo.idx, fo.label, {O.fcols(4, 'fo.')}"
            " FROM fl CROSS JOIN ss JOIN fo ON fo.fold <> fl.f"
            " AND ((ss.subset_id >> fo.minority_type) & 1) = 0),"
            " c AS (SELECT fold, subset_id, label, count(*) AS n FROM tr"
            " GROUP BY fold, subset_id, label),"
            " t AS (SELECT *, min(n) OVER (PARTITION BY fold, subset_id) AS mn,"
            " max(n) OVER (PARTITION BY fold, subset_id) AS mx FROM c),"
            f" num AS (SELECT *, row_number() OVER (PARTITION BY fold, subset_id, label ORDER BY idx)"
            f" - 1 AS pos, row_number() OVER (PARTITION BY fold, subset_id, label ORDER BY {hv}, idx)"
            " AS urn FROM tr),"
            f" r_none AS (SELECT 0 AS mid, fold, subset_id, idx, 0 AS sd, label, {f} FROM tr),"
            f" r_under AS (SELECT 1 AS mid, num.fold, num.subset_id, num.idx, 0, num.label, {nf}"
            " FROM num JOIN t ON num.fold = t.fold AND num.subset_id = t.subset_id"
            " AND num.label = t.label WHERE num.urn <= t.mn),"
            " odr AS (SELECT fold, subset_id, label, n, unnest(generate_series(1, mx - n)) AS s"
            " FROM t WHERE mx - n > 0 AND n > 0),"
            f" r_over AS (SELECT 2 AS mid, fold, subset_id, idx, 0, label, {f} FROM tr UNION ALL"
            f" SELECT 2, odr.fold, odr.subset_id, num.idx, 0, num.label, {nf} FROM odr JOIN num"
            " ON num.fold = odr.fold AND num.subset_id = odr.subset_id AND num.label = odr.label"
            f" AND num.pos = {O.draw_sql('odr.n', 'odr.label', 'odr.s')}),"
            " sdr AS (SELECT fold, subset_id, label, n, unnest(generate_series(1, mx // 2 - n)) AS s"
            " FROM t WHERE mx // 2 - n > 0),"
            " sdj AS (SELECT DISTINCT fold, subset_id, label, s,"
            f" {O.draw_sql('n', 'label', 's', 'j')} AS pos FROM (SELECT *,"
            " unnest(generate_series(1, 5)) AS j FROM sdr)),"
            f" syn AS (SELECT sdj.fold, sdj.subset_id, sdj.label, sdj.s, {avgs} FROM sdj JOIN num"
            " ON num.fold = sdj.fold AND num.subset_id = sdj.subset_id AND num.label = sdj.label"
            " AND num.pos = sdj.pos GROUP BY sdj.fold, sdj.subset_id, sdj.label, sdj.s),"
            f" r_smote AS (SELECT 3 AS mid, fold, subset_id, idx, 0, label, {f} FROM tr UNION ALL"
            f" SELECT 3, fold, subset_id, CAST(label AS BIGINT), s, label, {f} FROM syn),"
            " rsm AS (SELECT * FROM r_none UNION ALL SELECT * FROM r_under UNION ALL"
            " SELECT * FROM r_over UNION ALL SELECT * FROM r_smote),"
            " pr AS (SELECT r.mid, r.fold, r.subset_id, q.idx, q.label, r.idx AS n_idx,"
            " r.label AS n_label, row_number() OVER (PARTITION BY r.mid, r.fold, r.subset_id, q.idx"
            f" ORDER BY {O.d2_sql(4, 'q', 'r')}, r.sd > 0, r.idx, r.sd) AS rn FROM fo q JOIN rsm r"
            " ON r.fold = q.fold QUALIFY rn <= 5),"
            " votes AS (SELECT mid, fold, subset_id, idx, label, n_label, count(*) AS v FROM pr"
            " GROUP BY mid, fold, subset_id, idx, label, n_label),"
            " pred AS (SELECT mid, fold, subset_id, idx, label, n_label AS prediction,"
            " row_number() OVER (PARTITION BY mid, fold, subset_id, idx ORDER BY v DESC, n_label)"
            " AS r FROM votes QUALIFY r = 1),"
            " conf AS (SELECT mid, fold, subset_id, label, prediction, count(*) AS n FROM pred"
            " GROUP BY mid, fold, subset_id, label, prediction), "
            + O.rates_sql("conf", "mid, fold, subset_id") + ", "
            + O.metrics_sql("rates", "mid, fold, subset_id") +
            f", mn AS (SELECT * FROM (VALUES {methods}) v(name, id))"
            " SELECT fl.f AS fold, CAST(mn.id * 15 + ss.subset_id AS INTEGER) AS \"index\","
            " mn.name AS sampling, ss.subset AS minority_types, ss.subset_id,"
            f" {O.round_metrics('met.')}, met.n_classes_scored,"
            " CASE WHEN met.fold IS NULL THEN 'empty_class' ELSE 'ok' END AS status"
            " FROM fl CROSS JOIN mn CROSS JOIN ss LEFT JOIN met ON met.fold = fl.f"
            " AND met.mid = mn.id AND met.subset_id = ss.subset_id")


@query("subset_grid_metrics", _vote_grid_sql())
def subset_grid_metrics(spark, sf):
    """V3+V5+V6+R6+R7+L2: ten metrics for every fold x grade subset x method
    (none, undersample, oversample, smote) with the kNN-vote stand-in, one plan."""
    return vote_grid_metrics(_doc_graded(spark, sf))


# ----------------------------------------------------------------- M2, M4, S4

from stratum.functions.exprs import grade_name_expr, squared_distance  # noqa: E402
from stratum.operators.prepare import to_indexed  # noqa: E402


@query("type_report_names",
       O.doc_graded_prefix(5) + " SELECT label, minority_type, CASE minority_type WHEN 0 THEN"
       " 'safe' WHEN 1 THEN 'borderline' WHEN 2 THEN 'rare' WHEN 3 THEN 'outlier' END AS grade,"
       " count(*) AS n FROM g GROUP BY label, minority_type")
def type_report_names(spark, sf):
    """M2+M8: rows per (class, grade) with the grade's name."""
    r = G.type_report(_doc_graded(spark, sf, persist=False))
    return r.select("label", "minority_type", grade_name_expr("minority_type").alias("grade"), "n")


_RAW_SQL = (
    "WITH seg AS (SELECT c_mktsegment AS v, count(*) AS cnt FROM customer GROUP BY c_mktsegment),"
    " segi AS (SELECT v, CAST(row_number() OVER (ORDER BY cnt DESC, v) - 1 AS INTEGER) AS label"
    " FROM seg),"
    " ds AS (SELECT CAST(c.c_custkey AS BIGINT) AS idx, segi.label,"
    " CAST(c.c_acctbal AS DOUBLE) AS f0, CAST(c.c_nationkey AS DOUBLE) AS f1"
    " FROM customer c JOIN segi ON c.c_mktsegment = segi.v), "
    + O.scaled_sql("ds", 2) + ", " + O.knn_sql("sc", 2, 5) + ", " + O.graded_sql("sc", "nn", 5)
    + ' SELECT idx AS "index", label, minority_type FROM g')


@query("minority_types_raw", _RAW_SQL)
def minority_types_raw(spark, sf):
    """M4+P7+P3: exact typing of a raw table - customers keyed by ``c_custkey``, label the
    frequency-ranked market segment, features account balance and nation key."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal",
                                               "c_nationkey")
    labelled = string_index(cust, ["c_mktsegment"])
    idx = to_indexed(labelled, "c_mktsegment_idx", ["c_acctbal", "c_nationkey"],
                     index_col="c_custkey")
    return graded(idx, 5, persist=False).select("index", "label", "minority_type")


@query("results_round_trip", _vote_grid_sql())
def results_round_trip(spark, sf):
    """S4+V5: the experiment result table written per fold (header CSV, one folder per fold)
    and read back with its schema."""
    res = vote_grid_metrics(_doc_graded(spark, sf))
    path = FS.scratch_path(spark, "results")
    FS.write_results(res, path)
    back = spark.read.option("header", True).schema(res.schema).csv(path)
    return back.select(*res.columns)


# ----------------------------------------------------------------- the whole job

from stratum.plans.job import run_job  # noqa: E402


@query("job_end_to_end", _vote_grid_sql())
def job_end_to_end(spark, sf):
    """The whole job (S1, P1-P6, K3, M3, V1-V6, S4): a delimited file -> scale -> neighbours ->
    grades -> folds -> grid -> result files, one folder per fold, read back. The vote model
    stands in for the forest, so that every value can be checked."""
    raw = feature_columns(D.ds_doc(spark, sf), 4, digits=None, keep=("index", "label"))
    source, out = FS.scratch_path(spark, "job-in"), FS.scratch_path(spark, "job-out")
    raw.write.option("header", True).csv(source)
    res = run_job(spark, source, out, schema=raw.schema, label_col="label", index_col="index", model="vote",
                  search="exact")
    return res


@query("row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS \"index\" FROM orders")
def row_index(spark, sf):
    """Dense index of a table that stands in key order."""
    from stratum.operators.prepare import with_row_index
    o = table(spark, sf, "orders").select("o_orderkey")
    return with_row_index(o.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"))


@query("knn_cells_recall",
       "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_short, CAST(0 AS BIGINT) AS n_nearer,"
       " true AS recall_reached FROM embeddings")
def knn_cells_recall(spark, sf):
    """K4 against K3: every row has 5 neighbours, none nearer than the exact one of its rank,
    and the two-level cells find 0.9 of the exact pairs (the vectors barely cluster)."""
    e = D.ds_emb(spark, sf)
    exact, approx = K.knn(e, 5), knn_tree(e, 5, n_cells=16, recall=0.9)
    hit = approx.select("index", "n_index", F.lit(1).alias("hit"))
    best = exact.join(hit, ["index", "n_index"], "left").select("index", "rn", F.col("d2").alias("best"), "hit")
    per_row = (best.join(approx.select("index", "rn", "d2"), ["index", "rn"], "left").groupBy("index")
               .agg(F.count("d2").alias("n"), F.count_if(F.col("d2") < F.col("best")).alias("nearer"),
                    F.count("hit").alias("hits"), F.count(F.lit(1)).alias("pairs")))
    return per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") < 5).alias("n_short"),
                       F.sum("nearer").alias("n_nearer"),
                       (F.sum("hits") >= 0.9 * F.sum("pairs")).alias("recall_reached"))


@query("minority_counts_cells",
       O.doc_graded_prefix(5) + " SELECT label, count(*) AS n, true AS grades_agree FROM g GROUP BY label")
def minority_counts_cells(spark, sf):
    """K4 under M3: rows graded from the two-level cell search at a recall of 0.99, by class, and
    whether at least 0.95 of a class's rows get the grade that the exact search gives."""
    pts = _doc_scaled(spark, sf)
    g = G.minority_types(pts, 5, knn_tree(pts, 5, n_cells=16, recall=0.99)).select("index", "label", "minority_type")
    exact = G.minority_types(pts, 5, K.knn(pts, 5)).select("index", F.col("minority_type").alias("exact"))
    same = F.count_if(F.col("minority_type") == F.col("exact"))
    return g.join(exact, "index").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (same >= 0.95 * F.count(F.lit(1))).alias("grades_agree"))


@query("nearest_same_class_bounded", ORACLE["nearest_same_class"])
def nearest_same_class_bounded_q(spark, sf):
    """K5 by bounds of cells: the same distances as ``nearest_same_class``, far cells skipped."""
    d = nearest_same_class_bounded(_doc_scaled(spark, sf))
    return d.select("index", "label", F.round("distance", 6).alias("distance"))


@query("average_distance_bounded",
       f"WITH ds AS ({_B}) SELECT idx AS \"index\", label, true AS within_error FROM ds")
def average_distance_bounded_q(spark, sf):
    """K6 within a tolerance of 0.01, held against the exact average of every row."""
    pts = _doc_scaled(spark, sf)
    near = average_distance_bounded(pts, tolerance=0.01).select("index", F.col("avg_distance").alias("a"))
    off = F.abs(F.col("a") - F.col("avg_distance")) <= 0.01 * F.col("avg_distance") + 1e-9
    return K.average_distance(pts).join(near, "index").select(
        "index", "label", F.coalesce(off, F.col("a").isNull() & F.col("avg_distance").isNull()).alias("within_error"))


def _rank_sql(col: str) -> str:
    return (f"(SELECT {col} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS INTEGER) AS i"
            f" FROM part GROUP BY {col})")


@query("string_index_many",
       "SELECT p_partkey, a.i AS p_brand_idx, b.i AS p_type_idx, c.i AS p_name_idx FROM part"
       f" JOIN {_rank_sql('p_brand')} a ON a.v = p_brand JOIN {_rank_sql('p_type')} b ON b.v = p_type"
       f" JOIN {_rank_sql('p_name')} c ON c.v = p_name")
def string_index_many(spark, sf):
    """Three string columns indexed by dictionaries of one scan."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return string_index(part, ["p_brand", "p_type", "p_name"])


@query("sorted_sink_range",
       "SELECT o_orderkey AS \"index\", o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders"
       " WHERE o_orderkey BETWEEN (SELECT max(o_orderkey) // 4 FROM orders) AND (SELECT max(o_orderkey) // 2 FROM orders)")
def sorted_sink_range(spark, sf):
    """O1: a table written in ranges of its index, and the second quarter of the range read back."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("status"),
                                          F.round("o_totalprice", 2).alias("price"))
    path = FS.scratch_path(spark, "sorted")
    FS.write_sorted(o, path)
    last = o.agg(F.max("index")).first()[0] or 0
    return spark.read.parquet(path).where(F.col("index").between(last // 4, last // 2))


_LINE = ("CASE WHEN o_orderkey % 11 = 3 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN '' ELSE"
         " CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS {text}) END")


@query("rejects_and_medians",
       "WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 1 THEN CAST(round(o_totalprice, 2) AS DOUBLE) END AS price"
       " FROM orders WHERE o_orderkey % 11 <> 3)"
       " SELECT o_orderkey AS \"index\", coalesce(price, (SELECT quantile_disc(price, 0.5) FROM k)) AS price, 'kept' AS status FROM k"
       " UNION ALL SELECT o_orderkey, NULL, 'rejected' FROM orders WHERE o_orderkey % 11 = 3")
def rejects_and_medians(spark, sf):
    """S1, §1.2: a delimited file with values that are no numbers (rejected lines) and empty ones
    (replaced by the median of the column)."""
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.expr(_LINE.format(text="STRING")).alias("price"))
    path = FS.scratch_path(spark, "lines")
    lines.write.option("header", True).option("emptyValue", "").csv(path)
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("price", T.DoubleType())])
    kept, rejected = FS.read_with_rejects(spark, path, schema)
    kept = impute_median(kept, ["price"], accuracy=1_000_000).withColumn("status", F.lit("kept"))
    return kept.unionByName(rejected.select(F.split("record", ",")[0].cast("long").alias("index"),
                                            F.lit(None).cast("double").alias("price"), F.lit("rejected").alias("status")))
