"""Hand-worked goldens (FIXTURES section 4) and edge cases."""

import pytest
from pyspark.sql import functions as F

from stratum.functions.exprs import grade_expr
from stratum.operators import knn as K
from stratum.operators.folds import assign_folds
from stratum.operators.grading import minority_types, type_report
from stratum.operators.metrics import class_rates, metrics
from stratum.operators.prepare import min_max_scale
from stratum.operators.subsets import subset_list, subsets_table
from stratum.functions.exprs import subset_text


def pts(spark, rows):
    return spark.createDataFrame(rows, "index long, label int, features array<double>")


def test_grade_thresholds(spark):
    df = spark.range(0, 11).select(F.col("id").cast("int").alias("same"))
    g5 = [r[0] for r in df.where("same <= 5").select(grade_expr("same", 5)).collect()]
    g10 = [r[0] for r in df.select(grade_expr("same", 10)).collect()]
    assert g5 == [3, 2, 1, 1, 0, 0]
    assert g10 == [3, 3, 2, 2, 1, 1, 1, 1, 0, 0, 0]


ONE_D = [(0, 0.0, 0), (1, 1.0, 0), (2, 2.0, 0), (3, 3.0, 0), (4, 4.0, 0), (5, 5.0, 0),
         (6, 20.0, 1), (7, 21.0, 1), (8, 22.5, 1), (9, 2.2, 1), (10, 40.0, 0)]
NEIGHBOURS = {0: [1, 2, 9, 3, 4], 1: [0, 2, 9, 3, 4], 2: [9, 1, 3, 0, 4], 3: [9, 2, 4, 1, 5],
              4: [3, 5, 9, 2, 1], 5: [4, 3, 9, 2, 1], 6: [7, 8, 5, 4, 3], 7: [6, 8, 5, 4, 3],
              8: [7, 6, 5, 10, 4], 9: [2, 3, 1, 4, 0], 10: [8, 7, 6, 5, 4]}
GRADES = {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 1, 9: 3, 10: 1}


def one_d(spark):
    return pts(spark, [(i, lab, [x]) for i, x, lab in ONE_D])


def test_neighbours_golden(spark):
    nb = K.knn(one_d(spark), 5).collect()
    got = {}
    for r in sorted(nb, key=lambda r: (r["index"], r.rn)):
        got.setdefault(r["index"], []).append(r.n_index)
    assert got == NEIGHBOURS


def test_grades_golden(spark):
    g = {r["index"]: r.minority_type for r in minority_types(one_d(spark), 5).collect()}
    assert g == GRADES


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_knn_layout_independent(spark, parts):
    df = one_d(spark).repartition(parts)
    nb = K.knn(df, 5, block_rows=2)  # tiny blocks: many sub-blocks per cell
    got = {}
    for r in sorted(nb.collect(), key=lambda r: (r["index"], r.rn)):
        got.setdefault(r["index"], []).append(r.n_index)
    assert got == NEIGHBOURS


def test_cells_full_probe_is_exact(spark):
    df = one_d(spark)
    exact = K.knn(df, 3)
    approx = K.knn_cells(df, 3, n_cells=3, nprobe=3)
    assert K.recall(approx, exact).first()["recall"] == 1.0


def test_edge_one_row_and_small_n(spark):
    one = pts(spark, [(7, 1, [0.5, 0.5])])
    assert [(r["index"], r.minority_type) for r in minority_types(one, 5).collect()] == [(7, 3)]
    three = pts(spark, [(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])])
    nb = K.knn(three, 5).collect()
    assert len(nb) == 6  # n < k+1: every other row
    rep = {(r.label, r.minority_type): r.n for r in type_report(minority_types(three, 5)).collect()}
    assert sum(rep.values()) == 3


def test_identical_features_and_duplicate_points(spark):
    df = pts(spark, [(i, i % 2, [1.0, 1.0]) for i in range(6)])
    nb = K.knn(df, 2).collect()
    assert all(r.d2 == 0.0 for r in nb)
    # ties broken by neighbour id
    first = sorted([r for r in nb if r["index"] == 0], key=lambda r: r.rn)
    assert [r.n_index for r in first] == [1, 2]


def test_scaling_golden(spark):
    df = pts(spark, [(0, 0, [1.0, 7.0]), (1, 0, [3.0, 7.0])])
    got = sorted((r["index"], list(r.features)) for r in min_max_scale(df).collect())
    assert got == [(0, [0.0, 0.5]), (1, [1.0, 0.5])]


def test_subsets_golden(spark):
    text = ["[0 1 2 3]", "[1 2 3]", "[0 2 3]", "[2 3]", "[0 1 3]", "[1 3]", "[0 3]", "[3]",
            "[0 1 2]", "[1 2]", "[0 2]", "[2]", "[0 1]", "[1]", "[0]"]
    assert ["[" + " ".join(map(str, s)) + "]" for s in subset_list()] == text
    rows = subsets_table(spark).orderBy("subset_id").collect()
    assert [r.subset for r in rows] == text


@pytest.mark.parametrize("n,cuts", [(23, [0, 4, 8, 12, 16, 23]), (10, [0, 2, 4, 6, 8, 10])])
def test_fold_cuts(spark, n, cuts):
    df = pts(spark, [(i * 3 + 1, 0, [0.0]) for i in range(n)])
    f = assign_folds(df, 5).groupBy("fold").count().orderBy("fold").collect()
    sizes = [cuts[i + 1] - cuts[i] for i in range(5)]
    assert [r["count"] for r in f] == sizes


def test_metrics_golden(spark):
    m = [[50, 3, 2], [4, 10, 1], [0, 2, 3]]
    conf = spark.createDataFrame([(a, p, m[a][p]) for a in range(3) for p in range(3)],
                                 "label int, prediction int, n long")
    got = metrics(class_rates(conf)).first().asDict()
    want = dict(AvAvg=0.893333, MAvG=0.713766, RecM=0.725253, PrecM=0.697531, Recu=0.84,
                Precu=0.84, FbM=0.702904, Fbu=0.84, AvFb=0.702139, CBA=0.691919)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


@pytest.mark.parametrize("parts", [1, 5])
def test_dictionary_rank_matches_sort(spark, parts):
    from stratum.operators.prepare import dictionary
    vals = [f"v{i % 37:02d}" for i in range(500)] + [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(v,) for v in vals], "c string").repartition(parts)
    got = {r["value"]: r["label"] for r in dictionary(df, "c").collect()}
    counts = {}
    for v in vals:
        counts[v] = counts.get(v, 0) + 1
    want = {v: i for i, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v)))}
    assert got == want


def test_hot_class_split_matches_brute_force(spark):
    import math
    # class 0 holds 40 of 46 rows; block_rows=4 splits it into 10 x 10 sub-block pairs
    rows = [(i, 0 if i < 40 else 1 + i % 2, [float((i * 7) % 23), float((i * 5) % 11)])
            for i in range(46)]
    df = pts(spark, rows)

    def dist(a, b):
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))

    got = {r["index"]: r["distance"] for r in
           K.nearest_same_class_distance(df).collect()}
    nb = K.nearest_same_class(df, 1, block_rows=4).collect()
    got_small = {r["index"]: math.sqrt(r["d2"]) for r in nb}
    avg = {r["index"]: r["avg_distance"] for r in
           K.average_distance(df, block_rows=4).collect()}
    for i, lab, f in rows:
        same = [(j, g) for j, lj, g in rows if lj == lab and j != i]
        want = min(dist(f, g) for _, g in same)
        assert got[i] == pytest.approx(want) and got_small[i] == pytest.approx(want)
        want_avg = sum(dist(f, g) for _, g in same) / len(same)
        assert avg[i] == pytest.approx(want_avg)
