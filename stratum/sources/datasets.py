"""Indexed tables ``(index long, label int, features array<double>)`` derived from the
driver tables. Their definitions are mirrored in the oracle SQL of ``__spark_entry__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.prepare import alphabetical_dictionary
from stratum.sources.tables import table


def _text_features(text: str = "text", n_chars: str = "n_chars") -> list:
    t = F.col(text)
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return [F.col(n_chars).cast("double"), spaces.cast("double"), digits.cast("double"),
            newlines.cast("double")]


def doc_features(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, features`` (+ extra columns) computed right after the scan, so only the
    narrow feature array (never the text) crosses a shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", *extra)
    return docs.select("doc_id", *extra, F.array(*_text_features()).alias("features"))


def ds_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: label = quality*2 + toxic; features n_chars, spaces, digits,
    newlines of the text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = doc_features(spark, sf_dir).join(labels, "doc_id")
    return j.select(F.col("doc_id").cast("long").alias("index"),
                    (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"),
                    "features")


def ds_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: 64 float features cast to double, label as stored."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("index"),
                    F.col("label").cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("features"))


def ds_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, label = alphabetical dense rank of ``lang``; text features."""
    docs = doc_features(spark, sf_dir, extra=("lang",))
    d = alphabetical_dictionary(table(spark, sf_dir, "documents"), "lang")  # one row per language
    j = docs.join(d.withColumnRenamed("value", "lang"), "lang")  # AQE broadcasts it
    return j.select(F.col("doc_id").cast("long").alias("index"), F.col("label"), "features")


def ds_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: label = alphabetical dense rank of ``o_orderstatus``; feature total price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d = alphabetical_dictionary(o, "o_orderstatus")
    j = o.join(d.withColumnRenamed("value", "o_orderstatus"), "o_orderstatus")
    return j.select(F.col("o_orderkey").cast("long").alias("index"), F.col("label"),
                    F.array(F.col("o_totalprice").cast("double")).alias("features"))


DATASETS = {"DS_DOC": ds_doc, "DS_EMB": ds_emb, "DS_LANG": ds_lang, "DS_ORD": ds_ord}
