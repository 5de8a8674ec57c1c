"""Operator 7: mixing sources to target weights by a low-discrepancy source schedule.

Slot t of the schedule has the golden-ratio point frac(t * phi). The points run through the
cumulative target shares, so every stretch of the schedule takes each source in about its
share. A source's slots are ranked; slot k takes block k of the source's shuffled words,
beginning anew after the last block, at most ``MAX_PASSES`` times. Blocks hold equally many
words (the last of a source may hold fewer) and cut documents anywhere.

Numbers within a source (word offsets, slot ranks) are two-level: sums per bucket of at
most some thousand rows, running sums over the buckets, then a window inside the bucket.
So a source with a third of all rows never meets in one task. Only tables with one row per
source or per bucket are summed over in a single window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import count_words, read_table, stage, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
BLOCK_WORDS = 32
SEED = 7
#: Documents per offset bucket and slots per schedule bucket.
BUCKET_DOCS = 4096
BUCKET_SLOTS = 1 << 16
FRACTION_BITS = 52
#: 1 / golden ratio = (sqrt(5) - 1) / 2 as a 52-bit fraction, made odd.
GOLDEN = (math.isqrt(5 << (2 * FRACTION_BITS)) - (1 << FRACTION_BITS)) >> 1 | 1
#: The unit interval's cells, by which points find their sources.
CELLS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, target`` and the running target ``[low, high)`` in source order.

    Each source gets the share of its weight of the whole, at most ``max_passes`` times its
    size; what is over goes to the others by weight until none is above. That is the level
    L with sum(least(cap, weight * L)) = whole: sources reach their caps in the order of
    cap / weight. One row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
           .withColumn("rank", rank)
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                              (F.col("rank") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size").cast("double") * max_passes))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if exactly the sources before this one have reached their caps
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    per = per.withColumn("level", level).withColumn("fits", F.col("weight") * F.col("level") <= F.col("cap"))
    per = per.withColumn("level", F.min(F.struct(~F.col("fits"), F.col("cap") / F.col("weight"), "rank", "level"))
                         .over(everything)["level"])
    per = per.withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
    upto = everything.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum("target").over(upto)
    return per.select("source", "rank", "n_docs", "source_size", "target", (high - F.col("target")).alias("low"),
                      high.alias("high"), F.sum("source_size").over(everything).alias("whole"))


def golden_point(slot: Column) -> Column:
    """frac(slot * 1/phi), exact to 52 bits for slots under 2^44 (11 bits of the slot at a time)."""
    one = 1 << FRACTION_BITS
    parts = []
    for shift in (0, 11, 22, 33):
        digit = F.shiftrightunsigned(slot, shift).bitwiseAND(F.lit(2047))
        parts.append((digit * F.lit((GOLDEN << shift) % one)) % one)
    return ((parts[0] + parts[1] + parts[2] + parts[3]) % one).cast("double") / float(one)


def schedule(per: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The schedule: ``slot, rank`` (of the source) and ``block``, one row per slot taken.

    A slot finds its source through the cells of the unit interval that the source's share
    of the targets covers: an equi-join, so the list of sources needs no broadcast. Slots
    are numbered within a source by bucket. A source's slots after ``max_passes`` whole
    passes are left out; the low discrepancy keeps them to a few.
    """
    spark = per.sparkSession
    whole = per.agg(F.max("whole").alias("w")).first()["w"] or 0  # one number for the corpus
    n_slots = -(-int(whole) // block_words)
    slots = (spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
             .withColumn("cell", F.floor(F.col("u") * CELLS)))
    total = F.lit(float(max(whole, 1)))
    shares = per.where("target > 0").select(
        "rank", F.ceil(F.col("source_size") / block_words).alias("n_blocks"),
        (F.col("low") / total).alias("low"), (F.col("high") / total).alias("high"))
    shares = shares.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    dealt = (slots.join(shares, "cell").where("u >= low and u < high")
             .select("slot", "rank", "n_blocks", F.floor(F.col("slot") / BUCKET_SLOTS).alias("bucket")))
    in_bucket = Window.partitionBy("rank", "bucket")
    counts = dealt.groupBy("rank", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    k = F.col("before") + F.row_number().over(in_bucket.orderBy("slot")) - 1
    return (dealt.join(counts, ["rank", "bucket"]).withColumn("k", k)
            .where(F.col("k") < max_passes * F.col("n_blocks"))
            .select("slot", "rank", (F.col("k") % F.col("n_blocks")).alias("block")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES,
        block_words: int = BLOCK_WORDS, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, row``.

    Defined cases: null and empty texts have size 0 and nothing taken; documents without a
    source are a source of their own, the last; a null id is shuffled by its text; equal
    rows are interchangeable and each gets a row; an empty table gives an empty result;
    further columns are ignored. The order within a source hangs on seed, id and text only,
    so reruns agree.
    """
    text = text_of(docs, text_col)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sizes = stage(docs.select(row.cast("long").alias("row"), docs[id_col].alias("doc_id"),
                              docs[source_col].cast("string").alias("source"), count_words(text).alias("size"),
                              F.xxhash64(F.lit(seed), docs[id_col], text).alias("h")))
    per = stage(targets(sizes, weights, max_passes))
    times = schedule(per, block_words, max_passes).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))

    unit = F.shiftrightunsigned("h", 12).cast("double") / float(1 << 52)
    placed = (sizes.join(per, sizes["source"].eqNullSafe(per["source"]))
              .select("row", "doc_id", "size", "h", "rank", "source_size", "target",
                      F.floor(unit * F.ceil(F.col("n_docs") / BUCKET_DOCS)).alias("bucket")))
    counts = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy("rank", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(placed.withColumn("inside", F.coalesce(F.sum("size").over(upto), F.lit(0)))
                   .join(counts, ["rank", "bucket"])
                   .select("row", "doc_id", "size", "rank", "source_size", "target",
                           (F.col("before") + F.col("inside")).alias("start")))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.where("size > 0").select("row", "start", "size", "rank", F.explode(F.sequence(first, last)).alias("block"))
    words = (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
             - F.greatest("start", F.col("block") * block_words))
    taken = (cut.join(times, ["rank", "block"]).groupBy("row")
             .agg(F.sum(words * F.col("times")).cast("long").alias("taken")))
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("row")
