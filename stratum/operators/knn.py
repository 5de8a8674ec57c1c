"""Distances and nearest neighbours.

All neighbour searches run through one blocked kernel:

* every data row has a *cell* (one cell for the exact search, a k-means cell for the
  pruned search, the class label for same-class search); every query row has a list of
  cells to *probe*;
* per cell, data and queries are split into sub-blocks of at most ``block_rows`` rows by
  a hash of the row id, so a cell holding a third of all rows still becomes many bounded
  tasks;
* each (cell, data sub-block, query sub-block) group is an equi-join key of a
  ``cogroup().applyInPandas`` whose NumPy kernel computes the distance block in memory
  and emits only a partial top-k per query row (never all pairs);
* a ``row_number`` window keyed by the query id keeps the final k (Catalyst inserts a
  partial ``WindowGroupLimit`` before the shuffle).

Ties in distance are broken by neighbour id, so results do not depend on the layout. NULL,
NaN and infinite features fail the job: a distance from them has no meaning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.common import BROADCAST_MAX_ROWS

NEIGHBOUR_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("n_index", T.LongType()),
    T.StructField("n_label", T.IntegerType()),
    T.StructField("d2", T.DoubleType()),
])
# The kernel's rows: the cell searched, and the draw number of a synthetic neighbour (0: original).
KERNEL_SCHEMA = T.StructType([T.StructField("cell", T.IntegerType()), *NEIGHBOUR_SCHEMA.fields,
                              T.StructField("n_draw", T.LongType())])

DEFAULT_BLOCK_ROWS = 16_384
#: Rows from which ``knn`` goes through boxes, and most features for it.
BOX_MIN_ROWS, BOX_FEATURES = 65_536, 8


# ----------------------------------------------------------------- block kernel

#: Block groups of a kernel task, where there are more than the session's partitions.
TASK_GROUPS, MOST_TASKS = 4, 8192


def _kernel_partitions(df: DataFrame, groups: int | None = None) -> int:
    """Partitions for a CPU-heavy cogroup stage: enough for every core, never more than the
    number of block groups when that is known; a task has few of them, so its length does not grow
    with the rows. Fixed by an explicit repartition so AQE does not coalesce a
    small-but-expensive stage into one task."""
    sess = df.sparkSession
    n = max(sess.sparkContext.defaultParallelism,
            int(sess.conf.get("spark.sql.shuffle.partitions", "8")))
    return max(1, min(max(n, min(math.ceil(groups / TASK_GROUPS), MOST_TASKS)), groups)) if groups else n


def _cogroup(q: DataFrame, d: DataFrame, keys, fn, schema, parts: int) -> DataFrame:
    q = q.repartition(parts, *keys)
    d = d.repartition(parts, *keys)
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(fn, schema)

def _matrix(features: pd.Series) -> np.ndarray:
    """The feature arrays as one float matrix; values that are not finite are refused."""
    x = np.stack(features.to_numpy()).astype(np.float64, copy=False)
    if not np.isfinite(x).all():
        raise ValueError("a feature is NULL, NaN or infinite")
    return x


#: Pairs that a kernel holds at once, queries and columns of a tile, and most columns that one minimum stands for.
TILE_PAIRS, TILE_ROWS, TILE_COLUMNS, MINIMUM_OF = 1 << 21, 256, 1024, 64
#: Features from which single precision is tried, and pairs a neighbour that it may leave.
SINGLE_WIDTH, MOST_PAIRS = 16, 8
#: Pairs of a tile that distances are summed by.
SUM_PAIRS = 1 << 16
#: Squared distances below this share of the squared norms are not left to the matrix product.
SMALL_D2 = 1e-8


def _exact_d2(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (r, c), summed feature by feature, left to right, so every
    engine that sums (a1-b1)^2 + (a2-b2)^2 + ... in order gets the same bits."""
    d2 = np.zeros(len(r))
    for j in range(x.shape[1]):
        diff = x[r, j] - y[c, j]
        d2 += diff * diff
    return d2


def _distance_sums(qx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Of every row of ``qx`` the sum of its distances to the rows of ``dx``, by tiles that stay in
    a core's cache.

    One matrix product gives a tile's squared distances from the rows' middle. Where they are so
    small that rounding counts, or overflow, they are summed feature by feature."""
    middle = dx.mean(axis=0)
    q, d = qx - middle, dx - middle
    q_norms, d_norms = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", d, d)
    exact = not np.isfinite(q_norms.max() + d_norms.max())
    left = np.column_stack([-2.0 * q, q_norms, np.ones(len(q))])
    right = np.ascontiguousarray(np.vstack([d.T, np.ones(len(d)), d_norms]))
    small = SMALL_D2 * (q_norms + d_norms.max())
    step, s, every = max(1, SUM_PAIRS // len(dx)), np.zeros(len(qx)), np.arange(len(dx))
    for i in range(0, len(qx), step):
        rows = np.arange(i, min(i + step, len(qx)))
        if exact:
            d2 = _exact_d2(qx, dx, np.repeat(rows, len(dx)), np.tile(every, len(rows))).reshape(len(rows), -1)
        else:
            d2 = left[rows] @ right
            least = d2.min(axis=1) <= small[rows]
            if least.any():
                r, c = np.nonzero(d2 <= np.where(least, small[rows], -np.inf)[:, None])
                d2[r, c] = _exact_d2(qx, dx, i + r, c)
        s[rows] = np.sqrt(d2, out=d2).sum(axis=1)
    return s


def _near_pairs(qx: np.ndarray, dx: np.ndarray, k: int, own):
    """Pairs (row, column, squared distance) among which are every query's k nearest, by tiles of
    queries. ``own(i, j)`` lists the pairs of queries i to j that do not count, as (rows, columns).

    One matrix product estimates a tile's distances from the rows' middle. The k-th least of
    minima over separate columns bounds the k-th least distance; what lies below it, with room
    for the estimate's rounding, is computed exactly. Wide rows are estimated in single
    precision until that leaves too many pairs."""
    n, width = dx.shape
    middle = dx.mean(axis=0)
    q, d = qx - middle, dx - middle
    q_norms, d_norms = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", d, d)
    most = q_norms.max() + d_norms.max()
    kinds = [t for t in (np.float32, np.float64) if most < np.finfo(t).max / 16 and (t is np.float64 or width >= SINGLE_WIDTH)]
    made: dict = {}
    i = 0
    while i < len(qx):
        j = min(i + TILE_ROWS, len(qx))
        if not kinds:  # squares overflow: every pair is computed
            j = min(i + max(1, TILE_PAIRS // n), len(qx))
            every = np.ones((j - i, n), dtype=bool)
            every[own(i, j)] = False
            r, c = np.nonzero(every)
        else:
            kind = kinds[0]
            if kind not in made:
                made[kind] = (np.column_stack([-2.0 * q, np.ones(len(q))]).astype(kind),
                              np.ascontiguousarray(np.vstack([d.T, d_norms]).astype(kind)))
            left, right = made[kind]
            room = 16 * (width + 8) * float(np.finfo(kind).eps)
            slack = (room * (q_norms[i:j] + d_norms.max()) + float(np.finfo(kind).tiny) * 64 * (width + 8)).astype(kind)
            found = _below_bound(left[i:j], right, k, slack, own(i, j),
                                 None if kind is np.float64 else (j - i) * MOST_PAIRS * k)
            if found is None:
                kinds.pop(0)
                continue
            r, c = found
        yield i + r, c, _exact_d2(qx, dx, i + r, c)
        i = j


def _below_bound(left: np.ndarray, right: np.ndarray, k: int, slack: np.ndarray, out: tuple, most: int | None):
    """Pairs of one tile whose estimate ``left @ right`` lies within the slack of the k-th least; None
    beyond ``most`` pairs. Columns are taken in pieces that stay in a core's cache; the bound
    of the pieces seen so far filters each. ``out``: the pairs that do not count."""
    n = right.shape[1]
    least = np.full((len(left), k), np.inf, dtype=left.dtype)
    rows, cols, values, held = [], [], [], 0
    out_r, out_c = out
    if (out_c[1:] < out_c[:-1]).any():
        order = np.argsort(out_c, kind="stable")
        out_r, out_c = out_r[order], out_c[order]

    def kept() -> tuple:
        r, c, v = (np.concatenate(part) for part in (rows, cols, values))
        near = v <= (least.max(axis=1) + slack)[r]
        return r[near], c[near], v[near]

    for a in range(0, n, TILE_COLUMNS):
        b = min(a + TILE_COLUMNS, n)
        est = left @ right[:, a:b]
        some = slice(*np.searchsorted(out_c, (a, b)))
        est[out_r[some], out_c[some] - a] = np.inf
        minima, m = est, b - a
        while m >= 4 * k and m > TILE_COLUMNS // MINIMUM_OF:  # halves laid on one another
            m //= 2
            minima = np.minimum(minima[:, :m], minima[:, m:2 * m])
        least = np.partition(np.concatenate([least, minima], axis=1), k - 1, axis=1)[:, :k]
        r, c = np.divmod(np.flatnonzero(est <= np.minimum(least.max(axis=1) + slack, np.finfo(left.dtype).max)[:, None]), b - a)
        rows.append(r)
        cols.append(a + c)
        values.append(est[r, c])
        held += len(r)
        if held > TILE_PAIRS or b == n:  # the bound has come down: what lies above it goes
            r, c, v = kept()
            rows, cols, values, held = [r], [c], [v], len(r)
            if most is not None and held > most:
                return None
    return rows[0], cols[0]


def _first_of_places(x: np.ndarray, order: np.ndarray, part: np.ndarray | None, keep: int) -> np.ndarray:
    """Of rows with equal features (and part) the first ``keep`` of ``order``: all others have as many
    rows before them at the same distance from any query."""
    rows = np.ascontiguousarray(x[order] + 0.0)
    place = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    by = [place] if part is None else [part[order], place]
    at = np.lexsort(by)
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.any([b[at][1:] != b[at][:-1] for b in by], axis=0)
    number = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return order[np.sort(at[number < keep])]


def _block_topk(k: int, exclude_self: bool, skip_part: bool = False):
    """Pandas cogroup function: partial top-k of one query block against one data block.
    With ``skip_part`` rows of the query's own part are no neighbours."""

    def run(key, q, d):
        if q.empty or d.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="float64" if f.name == "d2" else
                                                   "int32" if isinstance(f.dataType, T.IntegerType)
                                                   else "int64") for f in KERNEL_SCHEMA.fields})
        qx, dx = _matrix(q["q_features"]), _matrix(d["features"])
        qi = q["q_index"].to_numpy(np.int64)
        di = d["index"].to_numpy(np.int64)
        dd = d["draw"].to_numpy(np.int64)
        d_part = d["part"].to_numpy() if skip_part else None
        copies = int(np.unique(di[dd == 0], return_counts=True)[1].max(initial=0)) if exclude_self else 0
        # of rows at one place the first k are enough, beside the query's own
        first = _first_of_places(dx, np.lexsort((dd, di, dd > 0)), d_part, k + copies)
        dx, di, dd, d_label = dx[first], di[first], dd[first], d["label"].to_numpy(np.int32)[first]
        if exclude_self:
            plain = np.flatnonzero(dd == 0)
            plain = plain[np.argsort(di[plain], kind="stable")]
            low, high = (np.searchsorted(di[plain], qi, side=s) for s in ("left", "right"))
        if skip_part:
            q_part, d_part = q["q_part"].to_numpy(), d_part[first]

        def own(i, j):
            rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            if exclude_self:
                for at in range(int((high[i:j] - low[i:j]).max(initial=0))):
                    r = np.flatnonzero(low[i:j] + at < high[i:j])
                    rows.append(r)
                    cols.append(plain[low[i:j][r] + at])
            if skip_part:
                c, r = np.nonzero(d_part[:, None] == q_part[None, i:j])
                rows.append(r)
                cols.append(c)
            return np.concatenate(rows), np.concatenate(cols)

        found = []
        for r, c, dv in _near_pairs(qx, dx, k, own):
            order = np.lexsort((dd[c], di[c], dd[c] > 0, dv, r))
            r, c, dv = r[order], c[order], dv[order]
            if len(r):
                starts = np.r_[True, r[1:] != r[:-1]]
                first = np.maximum.accumulate(np.where(starts, np.arange(len(r)), 0))
                keep = (np.arange(len(r)) - first) < k
                r, c, dv = r[keep], c[keep], dv[keep]
            found.append((r, c, dv))
        r, c, dv = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame({
            "cell": np.full(len(r), key[0], dtype=np.int32),
            "index": qi[r],
            "label": q["q_label"].to_numpy(np.int32)[r],
            "n_index": di[c],
            "n_label": d_label[c],
            "d2": dv,
            "n_draw": dd[c],
        })

    return run


def _top_k(partial: DataFrame, k: int, keys=("index",)) -> DataFrame:
    """The final k of each query (and cell) from the blocks' partial lists; originals come
    before synthetic rows at the same distance, then the smaller id, then the earlier draw."""
    w = Window.partitionBy(*keys).orderBy("d2", F.col("n_draw") > 0, "n_index", "n_draw")
    return partial.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def blocked_neighbours(query: DataFrame, data: DataFrame, k: int, *, exclude_self: bool,
                       block_rows: int = DEFAULT_BLOCK_ROWS, min_split: int = 1,
                       max_cells: int | None = None,
                       fixed_splits: tuple[int, int] | None = None,
                       per_cell: bool = False, skip_part: bool = False, keep_draw: bool = False) -> DataFrame:
    """Top-k neighbours of each query row among the data rows of the cells it probes.

    ``query``: ``index, label, features, probes array<int>``;
    ``data``: ``index, label, features, cell int``.
    Returns ``index, label, n_index, n_label, d2, rn`` (rn 1..k, by d2 then n_index). With
    ``per_cell`` a query gets its k neighbours in each cell it probes, and ``cell`` is a
    column. Synthetic data rows carry ``draw`` > 0 (their ``index`` is only a tie-break).
    With ``skip_part`` both tables have a column ``part`` (a fold), and rows of the query's
    own part are passed over inside the kernel, so one search serves all parts.
    ``keep_draw`` keeps the neighbour's draw number as ``n_draw``.

    ``max_cells`` is the proven bound on distinct cells (it sizes the broadcast of the split
    table); when None the split table is left to AQE. ``fixed_splits = (data splits, query
    splits)`` skips the split table (one cell whose sizes the caller counted).
    """
    keys = ["cell", "dsub", "qsub"]
    if "draw" not in data.columns:
        data = data.withColumn("draw", F.lit(0).cast("long"))

    d_cols = ["index", "label", "features", "cell", "draw", *(["part"] if skip_part else [])]
    q_cols = [F.col(c).alias(f"q_{c}") for c in ("index", "label", "features", *(["part"] if skip_part else []))]
    kernel = _block_topk(k, exclude_self, skip_part)

    def answer(partial: DataFrame) -> DataFrame:
        top = _top_k(partial, k, ("cell", "index") if per_cell else ("index",))
        return top.drop(*([] if per_cell else ["cell"]), *([] if keep_draw else ["n_draw"]))

    if fixed_splits is not None:
        sd, sq = fixed_splits
        d = (data.select(*d_cols)
             .withColumn("dsub", F.pmod(F.xxhash64("index", "draw"), F.lit(sd)).cast("int"))
             .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.lit(sq - 1)))))
        q = (query.select(*q_cols, F.explode("probes").alias("cell"))
             .withColumn("qsub", F.pmod(F.xxhash64("q_index", F.lit(7)), F.lit(sq)).cast("int"))
             .withColumn("dsub", F.explode(F.sequence(F.lit(0), F.lit(sd - 1)))))
        return answer(_cogroup(q, d, keys, kernel, KERNEL_SCHEMA,
                               _kernel_partitions(data, sd * sq)))
    dcnt = data.groupBy("cell").agg(F.count(F.lit(1)).alias("_dn"))
    qcnt = query.select(F.explode("probes").alias("cell")).groupBy("cell") \
        .agg(F.count(F.lit(1)).alias("_qn"))

    def nsplit(n):
        return F.least(F.greatest(F.ceil(n / F.lit(block_rows)), F.lit(min_split)), n).cast("int")

    splits = dcnt.join(qcnt, "cell").select("cell", nsplit(F.col("_dn")).alias("_sd"),
                                            nsplit(F.col("_qn")).alias("_sq"))
    parts = _kernel_partitions(data)
    if max_cells is not None:
        from stratum.session import reliable_checkpoint
        splits = reliable_checkpoint(splits, cache=False)  # a row per cell, bounded
        groups = splits.agg(F.sum(F.col("_sd").cast("long") * F.col("_sq"))).first()[0] or 1
        parts = max(parts, _kernel_partitions(data, groups))
        if max_cells <= BROADCAST_MAX_ROWS:
            splits = F.broadcast(splits)
    d = (data.select(*d_cols)
         .join(splits, "cell")
         .withColumn("dsub", F.pmod(F.xxhash64("index", "draw"), F.col("_sd")).cast("int"))
         .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1)))
         .drop("_sd", "_sq"))
    q = (query.select(*q_cols, F.explode("probes").alias("cell"))
         .join(splits, "cell")
         .withColumn("qsub", F.pmod(F.xxhash64("q_index", F.lit(7)), F.col("_sq")).cast("int"))
         .withColumn("dsub", F.explode(F.sequence(F.lit(0), F.col("_sd") - 1)))
         .drop("_sd", "_sq"))
    return answer(_cogroup(q, d, keys, kernel, KERNEL_SCHEMA, parts))


def parallel_split(df: DataFrame) -> int:
    par = df.sparkSession.sparkContext.defaultParallelism
    return max(1, int(math.ceil(math.sqrt(par))))


def knn(data: DataFrame, k: int, query: DataFrame | None = None, *,
        block_rows: int = DEFAULT_BLOCK_ROWS, n_rows: int | None = None,
        n_query_rows: int | None = None) -> DataFrame:
    """K3: exact k nearest neighbours (squared Euclidean, ties by id).

    Without ``query`` every data row is a query and is excluded from its own neighbours.
    Returns the long neighbour table ``index, label, n_index, n_label, d2, rn``. Large tables of
    few features are searched through boxes (``box_search``), others by all pairs.
    ``n_rows`` / ``n_query_rows``: row counts when the caller already has them (they only
    size the blocks); otherwise they are counted.
    """
    self_join = query is None
    nd = n_rows if n_rows is not None else data.count()
    if self_join and few_features(data, nd):
        from stratum.operators.box_search import knn_boxes
        return knn_boxes(data, k, block_rows=block_rows)
    qdf = data if self_join else query
    q = qdf.select("index", "label", "features", F.array(F.lit(0)).alias("probes"))
    d = data.select("index", "label", "features", F.lit(0).alias("cell"))
    # one cell: its split factors come from two counts (scalars), so no split-table join
    nq = nd if self_join else (n_query_rows if n_query_rows is not None else qdf.count())
    return blocked_neighbours(q, d, k, exclude_self=self_join, block_rows=block_rows,
                              fixed_splits=(_splits(data, nd, block_rows), _splits(data, nq, block_rows)))


def _splits(data: DataFrame, n: int, block_rows: int) -> int:
    """Blocks of ``n`` rows: enough for every core, none above ``block_rows``."""
    return max(1, min(max(math.ceil(n / block_rows), parallel_split(data), min(math.ceil(n / 2048), 2 * parallel_split(data))), n))


def few_features(data: DataFrame, n_rows: int) -> bool:
    """Whether ``data`` is large and narrow: searched through boxes, not by all pairs."""
    return n_rows >= BOX_MIN_ROWS and 0 < data.select(F.size("features")).first()[0] <= BOX_FEATURES


def nearest_same_class(data: DataFrame, k: int = 1, *,
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K5: the k nearest neighbours of each row within its own class (self excluded).

    The class label is the cell: every row probes only its own class, and a large class is
    split into sub-blocks like any hot cell.
    """
    q = data.select("index", "label", "features", F.array("label").alias("probes"))
    d = data.select("index", "label", "features", F.col("label").alias("cell"))
    return blocked_neighbours(q, d, k, exclude_self=True, block_rows=block_rows,
                              min_split=parallel_split(data))


def nearest_same_class_distance(data: DataFrame) -> DataFrame:
    """K5: ``index, label, distance`` to the nearest other row of the same class
    (NULL when the class has one row)."""
    nn = nearest_same_class(data, 1).select("index", F.sqrt("d2").alias("distance"))
    return data.select("index", "label").join(nn, "index", "left")


def average_distance(data: DataFrame, group_col: str = "label", *,
                     block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K6: for each row, sum of Euclidean distances to every row of its group (itself
    included, contributing 0) divided by (group size - 1).

    Runs through the same blocked cogroup with an all-pairs *sum* instead of a top-k, so
    only one row per (query row, block) leaves the kernel.
    """
    schema = T.StructType([T.StructField("index", T.LongType()),
                           T.StructField("s", T.DoubleType())])

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"index": pd.Series(dtype="int64"),
                                 "s": pd.Series(dtype="float64")})
        s = _distance_sums(_matrix(q["q_features"]), _matrix(d["features"]))
        return pd.DataFrame({"index": q["q_index"].to_numpy(np.int64), "s": s})

    base = data.select("index", "label", "features", F.col(group_col).alias("cell"))
    cnt = base.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    # about the block groups there are, if one group of rows holds most
    groups = math.ceil(data.count() / block_rows) ** 2
    splits = cnt.select("cell", "_n",
                        F.greatest(F.ceil(F.col("_n") / block_rows), F.lit(1)).cast("int")
                        .alias("_s"))
    d = (base.join(splits, "cell")
         .withColumn("dsub", F.pmod(F.xxhash64("index"), F.col("_s")).cast("int"))
         .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
         .select("cell", "dsub", "qsub", "index", "features"))
    q = (base.join(splits, "cell")
         .withColumn("qsub", F.pmod(F.xxhash64("index", F.lit(7)), F.col("_s")).cast("int"))
         .withColumn("dsub", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
         .select(F.col("cell").alias("cell"), F.col("dsub").alias("dsub"),
                 F.col("qsub").alias("qsub"), F.col("index").alias("q_index"),
                 F.col("features").alias("q_features")))
    keys = ["cell", "dsub", "qsub"]
    part = _cogroup(q, d, keys, run, schema, max(_kernel_partitions(data), _kernel_partitions(data, groups)))
    sums = part.groupBy("index").agg(F.sum("s").alias("s"))
    sizes = base.select("index", "label", "cell").join(cnt, "cell")
    return sizes.join(sums, "index").select(
        "index", "label",
        F.when(F.col("_n") > 1, F.col("s") / (F.col("_n") - 1)).alias("avg_distance"))


def neighbour_match_vector(neighbours: DataFrame) -> DataFrame:
    """K7: per row, the 0/1 vector "neighbour i has my label", in neighbour order."""
    m = neighbours.select("index", "label", "rn",
                          (F.col("n_label") == F.col("label")).cast("int").alias("m"))
    agg = m.groupBy("index", "label").agg(
        F.array_sort(F.collect_list(F.struct("rn", "m"))).alias("_v"))
    return agg.select("index", "label", F.transform("_v", lambda s: s["m"]).alias("matches"))


# ----------------------------------------------------------------- K4: cell-pruned search

def fit_cells(data: DataFrame, n_cells: int, seed: int = 42, max_iter: int = 20):
    """k-means centres (``n_cells x d`` array, bounded by the parameters) for cell pruning."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    vec = data.select(array_to_vector("features").alias("_v"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_v").fit(vec)
    return np.array(model.clusterCenters(), dtype=np.float64)


def _centre_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    dist = np.zeros((x.shape[0], centres.shape[0]))
    for j in range(x.shape[1]):
        diff = x[:, j, None] - centres[None, :, j]
        dist += diff * diff
    return dist


# Distances to centres held at once by a probing task, in numbers.
PROBE_CHUNK = 1 << 22


def nearest_cells(centres, nprobe: int):
    """Pandas UDF: ids of the ``nprobe`` nearest centres of each row (ties by id).

    ``centres`` is a broadcast of the ``n_cells x d`` array; rows are taken in chunks, so a
    task holds a bounded distance block whatever the batch and the number of cells."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probe(feats: pd.Series) -> pd.Series:
        c = centres.value
        out, step = [], max(1, PROBE_CHUNK // len(c))
        for i in range(0, len(feats), step):
            dist = _centre_distances(_matrix(feats.iloc[i:i + step]), c)
            out += list(np.argsort(dist, axis=1, kind="stable")[:, :nprobe].astype(np.int32))
        return pd.Series(out)

    return probe


def _cell_parts(data: DataFrame, centres):
    """Data rows with their own (nearest) cell, ready for ``blocked_neighbours``."""
    return data.select("index", "label", "features", nearest_cells(centres, 1)("features")[0].alias("cell"))


def knn_cells(data: DataFrame, k: int, n_cells: int, nprobe: int, query: DataFrame | None = None,
              *, seed: int = 42, block_rows: int = DEFAULT_BLOCK_ROWS,
              centres: np.ndarray | None = None) -> DataFrame:
    """K4: approximate kNN. Data rows live in their nearest k-means cell; each query row
    searches only its ``nprobe`` nearest cells. ``nprobe = n_cells`` is exact. Hot cells are
    split into bounded sub-blocks like any other cell. Same output as :func:`knn`.

    Every query gets k neighbours (or all there are): those with fewer search again with four
    times the cells, until none is short. The rounds are eager; each looks only at the short
    queries, and its result is checkpointed."""
    from stratum.session import reliable_checkpoint
    centres = centres if centres is not None else fit_cells(data, n_cells, seed)
    n_cells = centres.shape[0]
    shared = data.sparkSession.sparkContext.broadcast(centres)
    queries = (data if query is None else query).select("index", "label", "features")
    d = _cell_parts(data, shared)

    def search(rows: DataFrame, probes: int) -> DataFrame:
        q = rows.select("index", "label", "features", nearest_cells(shared, probes)("features").alias("probes"))
        return blocked_neighbours(q, d, k, exclude_self=query is None, block_rows=block_rows, max_cells=n_cells)

    nprobe = min(nprobe, n_cells)
    found = search(queries, nprobe)
    while nprobe < n_cells:
        found = reliable_checkpoint(found, cache=False)
        full = found.where(F.col("rn") == k).select("index")
        short = queries.join(full, "index", "left_anti")
        if short.isEmpty():
            break
        nprobe = min(4 * nprobe, n_cells)
        found = found.join(full, "index", "left_semi").unionByName(search(short, nprobe))
    return found


# Rows of a cell that the pruned exact search aims at.
CELL_ROWS = 4096


def knn_pruned(data: DataFrame, k: int, n_cells: int, *, block_rows: int = DEFAULT_BLOCK_ROWS,
               seed: int = 42, centres: np.ndarray | None = None) -> DataFrame:
    """K3, exact, without looking at all pairs: the same table as :func:`knn`.

    Rows live in k-means cells with a radius. A first pass searches near cells until every row
    has k neighbours; the k-th distance bounds what can be nearer. A second pass searches only
    those cells whose ball comes within that bound, by an equi-join on the cell. Cells that
    barely separate the rows are all searched, so the worst case is the all-pairs search.
    """
    from stratum.session import reliable_checkpoint
    centres = centres if centres is not None else fit_cells(data, n_cells, seed)
    spark, n_cells = data.sparkSession, centres.shape[0]
    near = knn_cells(data, k, n_cells, 1, block_rows=block_rows, centres=centres)
    if n_cells == 1:
        return near
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf(T.DoubleType())
    def own_distance(feats: pd.Series, cell: pd.Series) -> pd.Series:
        diff = _matrix(feats) - shared.value[cell.to_numpy()]
        return pd.Series(np.sqrt((diff * diff).sum(axis=1)))

    d = _cell_parts(data, shared)
    # one row per cell, at most n_cells: the cells' radii
    radii = np.zeros(n_cells)
    for r in d.select("cell", own_distance("features", "cell").alias("r")).groupBy("cell") \
            .agg(F.max("r").alias("r")).collect():
        radii[r["cell"]] = r["r"]
    reach = spark.sparkContext.broadcast(radii)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probes(feats: pd.Series, bound: pd.Series) -> pd.Series:
        c, out, step = shared.value, [], max(1, PROBE_CHUNK // n_cells)
        limit = bound.to_numpy(dtype=np.float64)
        for i in range(0, len(feats), step):
            dist = np.sqrt(_centre_distances(_matrix(feats.iloc[i:i + step]), c))
            # a little wider than the bound, for rounding
            hit = dist - reach.value[None, :] <= limit[i:i + step, None] * (1 + 1e-9) + 1e-9
            out += [np.flatnonzero(h).astype(np.int32) for h in hit]
        return pd.Series(out)

    bound = reliable_checkpoint(near.groupBy("index").agg(
        F.when(F.max("rn") == k, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf"))).alias("bound")), cache=False)
    q = data.select("index", "label", "features").join(bound, "index", "left").select(
        "index", "label", "features",
        probes("features", F.coalesce("bound", F.lit(float("inf")))).alias("probes"))
    return blocked_neighbours(q, d, k, exclude_self=True, block_rows=block_rows, max_cells=n_cells)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbour pairs found by an approximate search (one row)."""
    found = approx.select("index", "n_index", F.lit(True).alias("_hit"))
    j = exact.select("index", "n_index").join(found, ["index", "n_index"], "left")
    return j.agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"),
                 F.count(F.lit(1)).alias("pairs")) \
        .withColumn("recall", F.try_divide(F.col("hits"), F.col("pairs")))
