"""Delimited/parquet sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.prepare import features_text, parse_features_text
from stratum.session import checkpoint_dir, reliable_checkpoint
from stratum.sources.manifest import check_manifest, write_manifest

MINORITY_CSV_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("minority_type", T.IntegerType()),
    T.StructField("features", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared output root (``stratum.output.dir`` if set, else
    the session's checkpoint folder)."""
    root = spark.conf.get("stratum.output.dir", None) or checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               header: bool = True, fmt: str = "csv") -> DataFrame:
    """Read a delimited (or parquet) training table with an explicit schema; schema
    inference only when none is given."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", header)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def write_minority(minority: DataFrame, path: str, fmt: str = "csv") -> None:
    """S3: write the minority table; CSV keeps the reference's ``"[a,b,c]"`` feature text.
    Written in parallel (no single-file funnel)."""
    if fmt == "parquet":
        minority.write.mode("overwrite").parquet(path)
        return
    features_text(minority.select("index", "label", "minority_type", "features")) \
        .write.mode("overwrite").option("header", True).csv(path)


def read_minority(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a saved minority table and parse the feature text back to array<double>."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.option("header", True).schema(MINORITY_CSV_SCHEMA).csv(path)
    return parse_features_text(df)


def load_or_compute(spark: SparkSession, mode: str, path: str | None, compute, fmt: str = "csv",
                    origin: dict | None = None) -> DataFrame:
    """``read`` loads a saved minority table; ``write`` computes, saves and returns the
    saved copy (lineage cut at the file); anything else computes without saving.

    With ``origin`` (``manifest.made_from``) a written table gets a manifest, and ``read``
    refuses a table that is half-written, changed, or made from other files or parameters."""
    if mode == "read":
        if origin is not None:
            check_manifest(spark, path, origin)
        return read_minority(spark, path, fmt)
    df = compute()
    if mode == "write":
        write_minority(df, path, fmt)
        if origin is not None:
            write_manifest(spark, path, origin)
        return read_minority(spark, path, fmt)
    return df


def write_sorted(df: DataFrame, path: str, by: str = "index", files: int | None = None) -> None:
    """O1: Parquet files of disjoint, ascending ranges of ``by``, each sorted, so that a reader
    of a range opens few files and skips row groups by their statistics. The ranges come
    from a sample, so no task sorts the whole table. ``files``: how many (by size if not given)."""
    ranges = df.repartitionByRange(files, by) if files else df.repartitionByRange(by)
    ranges.sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, header: bool = True
                      ) -> tuple[DataFrame, DataFrame]:
    """S1, permissive: the rows that fit ``schema``, and a table ``record`` of the lines that do not
    (a value of another type, too many or too few fields). An empty field is a NULL, not a
    reject. The file is parsed once, every column of every line."""
    bad = "_rejected_record"
    whole = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = reliable_checkpoint(spark.read.option("header", header).option("mode", "PERMISSIVE")
                                 .option("columnNameOfCorruptRecord", bad).schema(whole).csv(path))
    return parsed.where(F.col(bad).isNull()).drop(bad), parsed.where(F.col(bad).isNotNull()).select(F.col(bad).alias("record"))


def write_results(results: DataFrame, path: str) -> None:
    """The result table, partitioned by fold (one folder per fold), header CSV. The
    result table is small (one row per experiment cell), so one file per fold."""
    results.repartition("fold").write.mode("overwrite").partitionBy("fold") \
        .option("header", True).csv(path)
