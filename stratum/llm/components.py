"""Connected components of a graph given by its edges, by alternating star contraction.

Each round points every node's larger neighbours, then its smaller ones, to its smallest
neighbour, until every component is a star around its smallest node. Rounds grow with the
logarithm of the longest path. Smallest neighbours are hash aggregates with map-side
combining. They are written out before they are joined back, so that Spark broadcasts them
where they are small and else can split the join at a node with very many neighbours. The
edges stay in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import stage


def _state(edges: DataFrame):
    """Number and digest of the edges: equal edge sets have equal states."""
    return edges.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``u, v``; longs).

    Loops and repeated edges change nothing; without edges the result is empty.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    edges = stage(edges.select(big.alias("u"), small.alias("v")).where("u > v").distinct())
    state = _state(edges)
    while state["n"]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        pointed = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.*")
        edges = stage(pointed.where("u > v").distinct())
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
