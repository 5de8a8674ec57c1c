"""The corpus pipeline: from the documents table to token digests, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept;
the check tool and ``run`` write each result as Parquet and read it back for the next. All
but the last return the columns of ``docs`` unchanged, carried as one struct so that no
column name can clash with an operator's own. A stage's intermediate tables are removed when
the next one begins, so their disk does not add up.

Defined cases, at every stage: a null text counts as empty, which the quality rules reject, so
later stages see none from this pipeline, but take them (empty texts are copies of each
other, near copies of nothing, never mixed in, and have no tokens). Of rows with the same id
and text one stays after exact dedup; a null id stands after every other. Documents without
a source are a source of their own. An empty table gives an empty result with the same
columns; further columns travel along whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.bpe import encode_documents
from stratum.llm.common import read_table, recording, remove_folders, stage, with_row_number
from stratum.llm.exact_dedup import exact_dedup
from stratum.llm.mixing import mix
from stratum.llm.ngram_join import ngram_components
from stratum.llm.quality import keep_documents


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents as one struct each, with a row number that later reads repeat; read
    where they stand, not written anew."""
    return with_row_number(docs, doc=F.struct("*"))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("row", "doc.doc_id", "doc.text", "doc.source")


def _without(rows: DataFrame, result: DataFrame) -> DataFrame:
    dropped = stage(result.where("not kept").select("row"))
    return rows.join(dropped, "row", "left_anti").select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return keep_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the first."""
    rows = _numbered(docs)
    return _without(rows, exact_dedup(_texts(rows), row_col="row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the first document."""
    rows = _numbered(docs)
    return _without(rows, ngram_components(_texts(rows), row_col="row"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words, in whole passes; those it leaves out go."""
    rows = _numbered(docs)
    times = mix(_texts(rows), row_col="row").where("size > 0").select(
        "row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    return rows.join(times, "row").select(
        "doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    return encode_documents(docs)


#: Intermediate tables of the stage that ran last.
_tables: list[str] = []


def _tidy(function):
    """A stage that first removes the tables of the stage before: that one's result is written by now."""

    @functools.wraps(function)
    def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_folders(spark, _tables)
        with recording(_tables):
            return function(spark, docs, sf_dir)

    return stage_function


STAGES = [(name, _tidy(function)) for name, function in (
    ("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mix), ("byte-level BPE", tokens))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the schedule's shuffle; the stages are tested against brute force.
ORACLE_SQL = None
