"""Operator 13: fill-in-the-middle documents, cut through a wavelet matrix of character classes.

Each byte of a text has a class (line break, blank, sentence end, later byte of a character,
any other). A wavelet matrix over the classes of a chunk of texts answers how many bytes of
a class stand before a place. Rank queries added up over the classes that end a unit count
the boundaries of a text (so its units); bisection on those ranks finds the place behind the
k-th boundary, where a cut goes; the rank of later bytes turns places into code points.
Texts are taken by chunks of some megabytes, whose queries are answered together; no row
meets another, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, text_of

OTHER, NEWLINE, BLANK, STOP, LATER = range(5)
CLASS_BITS = 3
#: The classes that end a unit; what stands behind the last of them is a unit too.
UNITS = {"lines": (NEWLINE,), "words": (NEWLINE, BLANK), "sentences": (NEWLINE, STOP)}
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes whose classes share one matrix; a longer text has one of its own.
CHUNK = 1 << 21

_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = LATER
_CLASS[0x0A] = NEWLINE
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
_CLASS[[ord(c) for c in ".!?"]] = STOP


class WaveletMatrix:
    """Counts of any class before any place of a sequence, in one bit per place and level."""

    def __init__(self, codes: np.ndarray, bits: int = CLASS_BITS):
        self.n, self.bits, self.levels = len(codes), bits, []
        for shift in range(bits - 1, -1, -1):
            ones = (codes >> shift & 1).astype(bool)
            packed = np.zeros((self.n >> 6) * 8 + 8, dtype=np.uint8)
            packed[:(self.n + 7) // 8] = np.packbits(ones, bitorder="little")
            words = packed.view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((shift, words, before, self.n - int(before[-1])))
            codes = np.concatenate((codes[~ones], codes[ones]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def rank(self, code: int, places: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place (0 to n)."""
        ends = np.concatenate(([0], places)).astype(np.int64)  # the first one follows the code's own start
        for shift, words, before, zeros in self.levels:
            ones = self._ones(words, before, ends)
            ends = zeros + ones if code >> shift & 1 else ends - ones
        return ends[1:] - ends[0]

    def count(self, codes: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many places before each one hold any of ``codes``."""
        return sum(self.rank(code, places) for code in codes)

    def behind(self, codes: tuple[int, ...], wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least place in lo..hi before which ``wanted`` of ``codes`` stand, by bisection on ranks."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            middle = (lo + hi) >> 1
            enough = self.count(codes, middle) >= wanted
            hi = np.where(enough, middle, hi)
            lo = np.where(enough | (lo == hi), lo, middle + 1)
        return lo


def _draws(seed: int, ids: list) -> np.ndarray:
    """Four 32-bit numbers for each document id, from the digest of ``seed:id``."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").reshape(-1, 4).astype(np.int64)


def cut_texts(bodies: list[bytes], draws: np.ndarray, ends: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """For each UTF-8 text its number of units, both cuts as byte offsets, and the code points
    before the first cut and between the cuts."""
    edges = np.cumsum([0] + [len(b) for b in bodies])
    start, end = edges[:-1], edges[1:]
    matrix = WaveletMatrix(_CLASS[np.frombuffer(b"".join(bodies), dtype=np.uint8)])
    base, total = matrix.count(ends, start), matrix.count(ends, end)
    closed = total - matrix.count(ends, np.maximum(end - 1, start))  # 1 where the last byte ends a unit
    breaks = total - base
    n = breaks + ((end > start) & (closed == 0))
    picks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    cuts = []
    for k in picks.T:
        found = matrix.behind(ends, base + np.minimum(k, breaks), start, end)
        cuts.append(np.where(k > breaks, end, found))
    first, second = cuts
    later = [matrix.rank(LATER, p) for p in (start, first, second)]
    return (n, first - start, second - start, first - start - later[1] + later[0],
            second - first - later[2] + later[1])


def _chunks(ids: list, texts: Iterator[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    some: tuple[list, list[bytes]] = ([], [])
    size = 0
    for i, body in zip(ids, texts, strict=True):
        if some[0] and size + len(body) > CHUNK:
            yield some
            some, size = ([], []), 0
        some[0].append(i)
        some[1].append(body)
        size += len(body)
    if some[0]:
        yield some


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines",
                   rate: int = 100, spm: int = 50, seed: int = 7,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    The text is cut into n units (``unit``: lines, words or sentences, each with the break
    that ends it). Two cuts between units are drawn from the sha256 of ``seed:id``; of the
    texts, ``rate`` percent are transformed, ``spm`` percent of these suffix first. ``output``
    is the transformed text; ``restored`` gives the original back. Plain texts stay as they
    are: those not drawn, empty ones, and those that hold a sentinel themselves.

    Defined cases: null text counts as empty; a null id is drawn as an empty one; repeated
    rows give repeated results; a text of any length is cut whole; an empty table gives an
    empty result; further columns are ignored whatever their names.
    """
    ends = UNITS[unit]
    marks = [s.encode() for s in sentinels]
    ddl = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, "
           "middle_chars long, output binary")
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            at = 0
            for ids, bodies in _chunks(batch.column(0).to_pylist(), (v.as_py() for v in batch.column(1))):
                draws = _draws(seed, ids)
                n, first, second, before, between = cut_texts(bodies, draws, ends)
                cols: list[list] = [[] for _ in types]
                for j, body in enumerate(bodies):
                    prefix, middle, suffix = body[:first[j]], body[first[j]:second[j]], body[second[j]:]
                    p, s, m = marks
                    if not body or draws[j, 2] % 100 >= rate or any(x in body for x in marks):
                        row = ("plain", None, None, body)
                    elif draws[j, 3] % 100 < spm:
                        row = ("spm", int(before[j]), int(between[j]), b"".join((s, suffix, p, prefix, m, middle)))
                    else:
                        row = ("psm", int(before[j]), int(between[j]), b"".join((p, prefix, s, suffix, m, middle)))
                    for col, value in zip(cols, (int(n[j]), *row), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                at += len(ids)

    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, ddl).withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text, from a transformed one and its form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (re.escape(mark) for mark in sentinels)
    return (F.when(form == "psm", F.regexp_replace(output, f"(?s)^{p}(.*){s}(.*){m}(.*)$", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, f"(?s)^{s}(.*){p}(.*){m}(.*)$", "$2$3$1")).otherwise(output))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1,
         CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3,
         CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
