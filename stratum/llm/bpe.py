"""Operator 6: byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local rank file whose path is a parameter. Python workers take Arrow
batches, one text at a time. A long text is cut first at boundaries no pattern match can
span, so the library never sees an unbounded run of pieces at once: after a letter and
before a single space that a letter follows. There the pattern must end a match before the
space and start the next one at it. The cut pieces' ids joined are the ids of the whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, text_of

#: Texts over this many characters are cut at safe boundaries into pieces of about this size.
CUT_CHARS = 20_000
#: A piece without safe boundary beyond this size is split match by match.
MATCH_CHARS = 200_000


def rank_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The encoding of a rank file; once for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@functools.lru_cache(maxsize=1)
def _patterns():
    import public_tokenizers
    import regex
    return regex.compile(public_tokenizers.PATTERN), regex.compile(r"(?<=\p{L})(?= \p{L})")


def pieces(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries; a piece is longer than ``size`` only where none is in reach."""
    safe, start = _patterns()[1], 0
    while len(text) - start > size:
        m = safe.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, path: str) -> list[int]:
    """Token ids of the whole text, each pattern match encoded separately."""
    enc = encoding(path)
    if len(text) <= CUT_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        if len(piece) <= MATCH_CHARS:
            ids += enc.encode_ordinary(piece)
        else:  # no safe boundary for long: take the matches one by one
            for m in _patterns()[0].finditer(piece):
                ids += enc.encode_ordinary(m.group()) if len(m.group()) <= MATCH_CHARS else _one_match(enc, m.group())
    return ids


def _one_match(enc, match: str) -> list[int]:
    """A single very long match; white space alone overflows the library's own splitter."""
    return enc._encode_single_piece(match.encode())


def decode(ids: list[int], path: str) -> bytes:
    """The raw bytes; ids may cut a character anywhere."""
    return encoding(path).decode_bytes(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids``.

    Every text is encoded whole and the ids are decoded again to raw bytes. Defined cases:
    null and empty texts have no tokens; a null id stays null; repeated rows give repeated
    results; an empty table gives an empty result; further columns are ignored.
    """
    path = path or rank_file()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    ddl = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(
        docs.schema[id_col].dataType.simpleString()) + (", ids array<int>" if keep_ids else "")

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                ids = encode(text.as_py(), path)
                raw = decode(ids, path)
                values = [len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(),
                          hashlib.sha256(raw).hexdigest()] + ([ids] if keep_ids else [])
                for col, value in zip(cols, values, strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))],
                names=["doc_id", *(n for n, _ in fields)])

    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(run, ddl)


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
