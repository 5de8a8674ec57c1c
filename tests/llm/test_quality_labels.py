"""The first stage of the pipeline against the labels of sf0.1, and the repeated-lines rule on small texts."""

from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from stratum.llm.common import read_table
from stratum.llm.quality import BIT, ledger

SF1 = "/root/testdata/sf0.1"


def test_clean_documents_are_not_dropped_for_a_headline(spark):
    docs, labels = read_table(spark, SF1, "documents"), read_table(spark, SF1, "labels")
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id")
    dropped = clean.join(STAGES[0][1](spark, docs, SF1), "doc_id", "left_anti")
    only = ledger(docs).where(F.col("failed") == BIT["repeated_lines"])
    assert clean.count() > 2000 and dropped.join(only, "doc_id").count() == 0


def test_bad_documents_are_not_let_in(spark):
    """All documents of quality 0 that are dropped by the share of repeated lines alone stay dropped."""
    docs, labels = read_table(spark, SF1, "documents"), read_table(spark, SF1, "labels")
    table = ledger(docs).join(labels.where("quality = 0"), "doc_id")
    loose = table.where("100 * n_dup_lines > 30 * n_lines")
    assert loose.count() > 50 and loose.where("failed = 0").count() == 0


def test_repeated_lines(spark):
    text = " ".join(f"word{i}" for i in range(100))
    short = "\n".join(["same short line"] * 5 + [f"other line number {i}" for i in range(5)])
    df = spark.createDataFrame([(0, f"A short headline\n{text}\nA short headline"), (1, short)], "doc_id long, text string")
    bits = {r["doc_id"]: bool(r["failed"] & BIT["repeated_lines"]) for r in ledger(df).collect()}
    assert bits == {0: False, 1: True}
