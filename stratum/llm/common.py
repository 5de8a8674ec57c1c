"""Helpers shared by the text operators: shared-folder tables and word patterns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words, as the inside of a regular-expression class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where ``recording`` collects the folders that are made meanwhile.
_record: list[str] | None = None


@contextlib.contextmanager
def recording(folders: list[str]):
    """Add the shared folders that are made inside the block to ``folders``."""
    global _record
    before, _record = _record, folders
    try:
        yield
    finally:
        _record = before


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more, and empty the list."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    while folders:
        path = path_of(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    A local folder is set only where the session names none and its master is local;
    a cluster session without the setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratum-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    if _record is not None:
        _record.append(folder)
    return folder


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes values such as generated row ids.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_row_key(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of the documents with a key ``file, at`` that tells every row and that later readings repeat.

    The key is the Parquet file's path (hashed) and the row's place in it. Rows that do not
    come straight from Parquet files are written to the shared folder first.
    """
    named = [column.alias(name) for name, column in columns.items()]
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"), *named)
        rows.schema  # noqa: B018 - analysed here, so a source without row numbers shows
        return rows
    except AnalysisException:
        written = stage(docs.select(*named))
        return with_row_key(written, **{name: written[name] for name in columns})


#: Bits of a row number that hold the row's place in its file.
PLACE_BITS = 40


def with_row_number(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of the documents with a number ``row`` that tells every row and that later
    readings repeat: the file's number and the row's place in it. The table of files, a row
    per file, is all that is written."""
    rows = with_row_key(docs, **columns)
    order = Window.partitionBy(F.lit(0)).orderBy("file")
    files = stage(rows.select("file").distinct().withColumn("number", F.row_number().over(order).cast("long")))
    row = F.shiftleft("number", PLACE_BITS).bitwiseOR(F.col("at"))
    return rows.join(F.broadcast(files), "file").select(row.alias("row"), *columns)


def text_of(df: DataFrame, col: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words, on the JVM."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
