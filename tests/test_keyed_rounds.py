"""Rounds of the keyed k-means."""

from stratum.operators import clusters


def test_centres_are_met_in_pieces(spark):
    rows = spark.range(400).selectExpr("id AS index", "CAST(id % 2 AS INT) AS label",
                                       "array(CAST(id % 7 AS DOUBLE), CAST(id % 5 AS DOUBLE)) AS features")
    few = clusters.keyed_clusters(rows, [3]).orderBy("index").collect()
    clusters_pairs, clusters.NEAREST_PAIRS = clusters.NEAREST_PAIRS, 8
    try:
        assert clusters.keyed_clusters(rows, [3]).orderBy("index").collect() == few
    finally:
        clusters.NEAREST_PAIRS = clusters_pairs
