"""Exact neighbours of rows with few features through boxes.

Rows that stand at one place (equal features) share their neighbours, so places are searched:
of a place only the rows of least id can be anybody's neighbours. The places are cut into
boxes of about ``BOX_ROWS`` rows by a tree of median splits, fitted on a bounded sample. A
first pass searches a place's own box; its k-th distance bounds what can be nearer. A second
pass searches the other boxes that come within that distance, found by descending the tree.

With few features a ball of k rows meets few boxes, so the search costs about a constant
number of boxes a row; :func:`knn.knn` compares all pairs where features are many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.knn import DEFAULT_BLOCK_ROWS, _matrix, _top_k, blocked_neighbours
from stratum.session import reliable_checkpoint

#: Rows that a box aims at, most boxes, and sampled rows that a box is fitted on.
BOX_ROWS, MOST_BOXES, FIT_ROWS = 2048, 16_384, 16
#: Queries that descend the tree at once.
DESCENT_ROWS = 4096


@dataclass
class BoxTree:
    """Nodes of median splits: row goes ``left`` where ``x[dim] < cut``; ``cell`` is -1 in inner nodes.
    ``lo``, ``hi``: corners of what a node holds."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    n_cells: int
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.cell[node[rows]] < 0]
            at = node[rows]
            node[rows] = np.where(x[rows, self.dim[at]] < self.cut[at], self.left[at], self.right[at])
        return self.cell[node]

    def bounded(self, corners: dict) -> BoxTree:
        """The tree with the corners of its cells, ``cell`` to (low, high); children follow their parents."""
        width = len(next(iter(corners.values()))[0])
        lo, hi = np.full((len(self.cell), width), np.inf), np.full((len(self.cell), width), -np.inf)
        for i in range(len(self.cell) - 1, -1, -1):
            c = int(self.cell[i])
            if c >= 0 and c in corners:
                lo[i], hi[i] = corners[c]
            elif c < 0:
                a, b = self.left[i], self.right[i]
                lo[i], hi[i] = np.minimum(lo[a], lo[b]), np.maximum(hi[a], hi[b])
        return BoxTree(self.dim, self.cut, self.left, self.right, self.cell, self.n_cells, lo, hi)

    def gaps(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance from row i to what node i holds."""
        gap = np.maximum(np.maximum(self.lo[node] - x, x - self.hi[node]), 0.0)
        return (gap * gap).sum(axis=1)

    def within(self, x: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
        """The cells that come within the squared distance ``limit`` of every row."""
        rows, node, found = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), []
        while len(rows):
            near = self.gaps(x[rows], node) <= limit[rows]
            rows, node = rows[near], node[near]
            leaf = self.cell[node] >= 0
            found.append((rows[leaf], self.cell[node[leaf]]))
            rows, node = rows[~leaf], node[~leaf]
            rows, node = np.concatenate([rows, rows]), np.concatenate([self.left[node], self.right[node]])
        r, c = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(r, kind="stable")
        return np.split(c[order].astype(np.int32), np.cumsum(np.bincount(r, minlength=len(x)))[:-1])

    def nearest(self, x: np.ndarray, m: int) -> list[np.ndarray]:
        """The ``m`` cells that come nearest to every row."""
        leaves = np.flatnonzero(self.cell >= 0)
        out = []
        for row in x:
            gap = self.gaps(np.broadcast_to(row, (len(leaves), len(row))), leaves)
            out.append(self.cell[leaves[np.argsort(gap, kind="stable")[:m]]].astype(np.int32))
        return out


def split_boxes(sample: np.ndarray, n_cells: int) -> BoxTree:
    """Median splits of a sample along its widest feature, down to its share of a cell."""
    most = max(1, len(sample) // max(1, n_cells))
    nodes, parts, cells, i = [[0, 0.0, 0, 0, -1]], [sample], 0, 0
    while i < len(nodes):
        x = parts[i]
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        dim = int(np.argmax(spread))
        if len(x) <= most or not spread[dim] > 0:
            nodes[i][4], cells = cells, cells + 1
        else:
            values = np.sort(x[:, dim])
            cut = values[len(values) // 2]
            cut = cut if values[0] < cut else values[np.searchsorted(values, cut, side="right")]
            less = x[:, dim] < cut
            nodes[i][:4] = [dim, cut, len(nodes), len(nodes) + 1]
            nodes += [[0, 0.0, 0, 0, -1], [0, 0.0, 0, 0, -1]]
            parts += [x[less], x[~less]]
        parts[i] = None
        i += 1
    dim, cut, left, right, cell = (np.array(c) for c in zip(*nodes, strict=True))
    return BoxTree(dim, cut, left, right, cell, cells)


def _fitted(data: DataFrame, box_rows: int, width: int) -> BoxTree:
    """Splits from a sample of ``FIT_ROWS`` rows for each box, chosen by a hash of the id."""
    n = data.count()
    n_cells = max(1, min(math.ceil(n / box_rows), MOST_BOXES))
    if n_cells == 1:
        return split_boxes(np.zeros((0, width)), 1)
    share = min(1.0, n_cells * FIT_ROWS / n)
    sample = data.where(F.pmod(F.xxhash64("index", F.lit(17)), F.lit(1 << 30)) < F.lit(share) * float(1 << 30))
    columns = sample.select(*[F.col("features")[i].alias(f"f{i}") for i in range(width)]).toArrow()
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns.columns])
    return split_boxes(x[np.isfinite(x).all(axis=1)], n_cells)


def box_neighbours(queries: DataFrame, data: DataFrame, k: int, *, skip_part: bool = False,
                   box_rows: int = BOX_ROWS, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The k nearest data rows of every query, a query's own row included where it is one:
    ``index, label, n_index, n_label, d2, rn``. With ``skip_part`` rows of the query's own
    ``part`` are passed over. Both tables are read several times, so hand in written ones."""
    spark = data.sparkSession
    first = data.select(F.size("features")).first()
    if first is None:
        return queries.limit(0).select("index", "label", F.col("index").alias("n_index"), F.col("label").alias("n_label"),
                                       F.lit(0.0).alias("d2"), F.lit(1).alias("rn"))
    width = first[0]
    tree = _fitted(data, box_rows, width)
    plain = spark.sparkContext.broadcast(tree)

    @F.pandas_udf(T.IntegerType())
    def own(feats: pd.Series) -> pd.Series:
        return pd.Series(plain.value.own(_matrix(feats)).astype(np.int32))

    part = ["part"] if skip_part else []
    d = data.select("index", "label", "features", *part, own("features").alias("cell"))
    q = queries.select("index", "label", "features", *part, own("features").alias("own"))

    def search(rows: DataFrame) -> DataFrame:
        return blocked_neighbours(rows, d, k, exclude_self=False, skip_part=skip_part, keep_draw=True, block_rows=block_rows,
                                  max_cells=tree.n_cells)

    found = search(q.withColumn("probes", F.array("own")))
    if tree.n_cells == 1:
        return found.drop("n_draw")
    d = reliable_checkpoint(d, cache=False)
    found = reliable_checkpoint(search(q.withColumn("probes", F.array("own"))), cache=False)
    # a row per box: its corners
    ends = [f(F.col("features")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]
    corners = {r["cell"]: ([r[f"lo{i}"] for i in range(width)], [r[f"hi{i}"] for i in range(width)])
               for r in d.groupBy("cell").agg(*ends).collect()}
    boxes = spark.sparkContext.broadcast(tree.bounded(corners))

    def nearest(m: int):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def run(feats: pd.Series) -> pd.Series:
            return pd.Series(boxes.value.nearest(_matrix(feats), m))
        return run

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def within(feats: pd.Series, bound: pd.Series) -> pd.Series:
        limit, out = bound.to_numpy(dtype=np.float64), []
        for i in range(0, len(feats), DESCENT_ROWS):
            # a little wider than the bound, for rounding
            out += boxes.value.within(_matrix(feats.iloc[i:i + DESCENT_ROWS]), limit[i:i + DESCENT_ROWS] * (1 + 1e-9) + 1e-300)
        return pd.Series(out)

    bound = found.where(F.col("rn") == k).select("index", F.col("d2").alias("bound"), F.lit(True).alias("settled"))
    short, m = reliable_checkpoint(q.join(bound, "index", "left_anti"), cache=False), 1
    while m < tree.n_cells and not short.isEmpty():
        m = min(8 * m, tree.n_cells)
        wider = reliable_checkpoint(search(short.withColumn("probes", nearest(m)("features"))), cache=False)
        wide = wider.where(F.col("rn") == k).select("index", F.col("d2").alias("bound"), F.lit(False).alias("settled"))
        bound = bound.unionByName(wide)
        short = reliable_checkpoint(short.join(wide, "index", "left_anti"), cache=False)
    # a query whose own box had k rows keeps them and searches the others; the rest search anew
    unbound = F.coalesce("bound", F.lit(float("inf")))
    asked = q.join(bound, "index", "left").withColumn("probes", within("features", unbound))
    kept = F.coalesce("settled", F.lit(False))
    asked = asked.withColumn("probes", F.when(kept, F.array_remove("probes", F.col("own"))).otherwise(F.col("probes")))
    asked = reliable_checkpoint(asked.where(F.size("probes") > 0).select("index", "label", "features", *part, "probes"), cache=False)
    settled = found.join(bound.where("settled").select("index"), "index", "left_semi")
    return _top_k(settled.drop("rn").unionByName(search(asked).drop("rn")), k).drop("n_draw")


def _first_rows(rows: DataFrame, by, k: int) -> DataFrame:
    """The k rows of least id at every place; ``at`` is the row's number there."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("index"))).where(F.col("at") <= k)


def _lists(found: DataFrame, *more: str) -> DataFrame:
    entry = F.struct("rn", "n_index", "n_label", "d2", *more)
    return found.groupBy("index").agg(F.sort_array(F.collect_list(entry)).alias("near"))  # k entries


def knn_boxes(data: DataFrame, k: int, *, skip_part: bool = False, box_rows: int = BOX_ROWS,
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K3: the table of :func:`knn.knn` (no row its own neighbour), or with ``skip_part`` every
    row's k nearest rows of the other parts. Features must be few (see above) to be fast."""
    by = ["features", "part"] if skip_part else ["features"]
    k_place = k if skip_part else k + 1  # a row at the place leaves itself out
    rows = data.select("index", "label", *by)
    kept = reliable_checkpoint(_first_rows(rows, by, k_place), cache=False)
    heads = kept.where("at = 1").drop("at")
    found = box_neighbours(heads, kept, k_place, skip_part=skip_part, box_rows=box_rows, block_rows=block_rows)
    places = heads.select("index", *by).join(_lists(found), "index").drop("index")
    # many rows may stand at one place: a join that adaptive execution can split
    near = F.filter("near", lambda c: c["n_index"] != F.col("index"))
    out = rows.join(reliable_checkpoint(places, cache=False), by).select(
        "index", "label", F.posexplode(F.slice(near, 1, k)).alias("pos", "c"))
    return out.select("index", "label", "c.n_index", "c.n_label", "c.d2", (F.col("pos") + 1).alias("rn"))


def knn_boxes_by(data: DataFrame, k: int, group: str, groups, *, box_rows: int = BOX_ROWS,
                 block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``index, near``: every row's k nearest rows of the other parts in each of the given ``groups``
    (short: a search each), one array of ``(rn, n_index, n_label, d2, group)``."""
    rows = data.select("index", "label", "features", "part", group)
    heads = reliable_checkpoint(_first_rows(rows, ["features", "part"], 1).drop("at", group), cache=False)
    each = []
    for g in groups:
        mine = reliable_checkpoint(_first_rows(rows.where(F.col(group) == g), ["features", "part"], k).drop("at"), cache=False)
        found = box_neighbours(heads, mine, k, skip_part=True, box_rows=box_rows, block_rows=block_rows)
        each.append(reliable_checkpoint(found, cache=False).withColumn(group, F.lit(g)))
    every = each[0]
    for one in each[1:]:
        every = every.unionByName(one)
    places = heads.select("index", "features", "part").join(_lists(every, group), "index").drop("index")
    return rows.select("index", "features", "part").join(reliable_checkpoint(places, cache=False), ["features", "part"]).select("index", "near")
