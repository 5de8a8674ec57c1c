"""What a saved table was made from, kept beside it.

A saved table is served again only if its manifest says that it is whole and was made from
the same input files with the same parameters. The manifest is renamed into place after the
table's files are complete, so a table whose writing was cut short has none.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

NAME = "_manifest.json"


class StaleTable(ValueError):
    """A saved table that must not be read: half-written, changed, or made from something else."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _digest(entries: list) -> str:
    return hashlib.sha256(json.dumps(sorted(entries)).encode()).hexdigest()


def made_from(inputs: DataFrame, **parameters) -> dict:
    """The fingerprint of a table: a digest of its input files (path, length, time of change) and its parameters."""
    spark, entries = inputs.sparkSession, []
    for name in inputs.inputFiles():
        fs, path = _files(spark, name)
        status = fs.getFileStatus(path)
        entries.append([path.toString(), status.getLen(), status.getModificationTime()])
    return {"inputs": _digest(entries), "input_files": len(entries),
            "parameters": json.loads(json.dumps(parameters, default=str, sort_keys=True))}


def _contents(spark: SparkSession, path: str) -> dict:
    """Number and digest (name, length) of the data files below ``path``."""
    fs, where = _files(spark, path)
    entries, found = [], fs.listFiles(where, True) if fs.exists(where) else None
    while found is not None and found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            entries.append([name, status.getLen()])
    return {"files": len(entries), "contents": _digest(entries)}


def write_manifest(spark: SparkSession, path: str, origin: dict) -> None:
    """Record beside the finished table at ``path`` what it was made from and what it holds."""
    fs, target = _files(spark, f"{path.rstrip('/')}/{NAME}")
    partial = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{NAME}.partial")
    out = fs.create(partial, True)
    try:
        out.write(bytearray(json.dumps({"origin": origin, **_contents(spark, path)}).encode()))
    finally:
        out.close()
    if not fs.rename(partial, target):
        raise OSError(f"cannot put {NAME} beside {path}")


def check_manifest(spark: SparkSession, path: str, origin: dict) -> None:
    """Raise :class:`StaleTable` unless the table at ``path`` is whole and was made from ``origin``."""
    fs, target = _files(spark, f"{path.rstrip('/')}/{NAME}")
    if not fs.exists(target):
        raise StaleTable(f"{path} has no manifest: its writing did not end")
    stream = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    saved = json.loads(text)
    now = _contents(spark, path)
    if any(saved[k] != now[k] for k in now):
        raise StaleTable(f"{path} does not hold the files it was written with")
    wanted = json.loads(json.dumps(origin))
    wrong = [k for k in wanted if saved["origin"].get(k) != wanted[k]]
    if wrong:
        raise StaleTable(f"{path} was made from other {', '.join(wrong)}")
