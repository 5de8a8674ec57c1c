"""Operator 1: exact deduplication by distributed MSD radix partitioning.

Documents are split by successive digits of their normalised bytes, most significant
first. A digit is a run of bytes (64, then 8 times as many each round), so the number of
rounds grows with the logarithm of the longest text. A group that holds one document, or
whose documents have all ended, leaves the recursion. Equality is decided by the bytes
alone, no digest.

What is shuffled is a row's number, group and one digit, never its body. After the first
digit the bodies of the open groups' documents alone are written, once, and later rounds cut
their digits from there.

Group sizes are hash aggregates over (group, digit) with map-side combining, so a group
that holds a third of all rows reaches the shuffle as one row per task. The sizes of groups
of two or more are written out and joined back as a table of their own: Spark broadcasts it
where its files are below the limit, else both sides are dealt out for the join alone and
adaptive execution splits a hot group among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import SPACE_CLASS, read_table, shared_folder, stage, text_of, with_row_number

FIRST_DIGIT = 64
DIGIT_GROWTH = 8


def normalised(text):
    """Each run of white space as one space."""
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                row_col: str | None = None, first_digit: int = FIRST_DIGIT,
                growth: int = DIGIT_GROWTH) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``row``.

    Of rows with equal normalised text, the one with the smallest id stays. ``row`` is
    ``row_col`` where given (it must be unique), else a number that the file and place give.

    Defined cases: null text counts as empty, and all empty texts are one group; a null id
    sorts after every other, so ``keep_id`` is null only if the whole group has null ids;
    of rows that repeat an id and its text, exactly one is kept; an empty table gives an
    empty result; further columns of ``docs`` are ignored whatever their names.
    """
    columns = {"id": docs[id_col], "text": text_of(docs, text_col)}
    if row_col:
        rows = docs.select(docs[row_col].cast("long").alias("row"), *[c.alias(n) for n, c in columns.items()])
    else:
        rows = with_row_number(docs, **columns)
    base = rows.select("row", "id", normalised(F.col("text")).cast("binary").alias("body"))
    root = shared_folder(docs.sparkSession)

    def digits(offset: int, width: int) -> list:
        """The digit behind ``offset`` bytes, and whether the body ends with it."""
        return [F.expr(f"substring(body, {offset + 1}, {width})").alias("digit"), (F.length("body") <= offset + width).alias("ended")]

    def close(split: DataFrame, level: int) -> DataFrame:
        """Give each row its group after this digit; a row of an open group goes on."""
        shared = (split.groupBy("grp", "digit", "ended")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
                  .where("n > 1"))
        joined = split.join(stage(shared, f"{root}/shared-{level}"), ["grp", "digit", "ended"], "left")
        is_open = F.col("n").isNotNull() & ~F.col("ended")
        out = joined.select(
            "row", "id", "sha", F.when(is_open, F.col("first.row")).otherwise(0).cast("long").alias("grp"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"), is_open.alias("open"))
        folder = f"{root}/level-{level}"
        out.write.option("compression", "zstd").partitionBy("open").parquet(folder)
        return docs.sparkSession.read.schema(out.schema).parquet(folder)

    level, offset, width = 0, 0, first_digit
    table = close(base.select("row", "id", F.sha2("body", 256).alias("sha"), F.lit(0).cast("long").alias("grp"),
                              *digits(offset, width)), level)
    done, bodies = [table.where("not open")], None
    while not table.where("open").isEmpty():
        left = table.where("open").select("row", "id", "sha", "grp")
        if bodies is None:
            bodies = stage(base.select("row", "body").join(left.select("row"), "row", "left_semi"), f"{root}/bodies")
        level, offset, width = level + 1, offset + width, width * growth
        table = close(bodies.select("row", *digits(offset, width)).join(left, "row"), level)
        done.append(table.where("not open"))
    result = done[0]
    for part in done[1:]:
        result = result.unionAll(part)
    return result.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept",
                         F.col("sha").alias("text_sha256"), "row")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("row")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
