"""Operator 12: removal of repeated passages by fixed-block anchors.

A passage counts as repeated where a window of ``window`` words also starts elsewhere. Every
such window holds a whole one of its document's non-overlapping blocks of (window + 1) / 2
words. So:

1. Every rolling run of a block's length probes the blocks of all documents. Runs and blocks
   meet as sorted, distinct hashes, packed by flush of a task and shard of the hash space: a
   run that a third of all documents hold is sent once per flush, whatever its copies. A
   block is an anchor if its hash stands at two places or more.
2. Anchors are found back in their documents by a semi-join.
3. Around its anchors a document is extended: of the windows that hold an anchor, those that
   stand twice or more, by a 96-bit hash, are repeats; overlapping ones join to maximal
   repeated spans. The windows' hashes are again met packed and distinct; the answer is one
   bit per hash, in the order in which it was asked.
4. Words inside a span go.

No pairs are made: the work is proportional to the words, then to the words near anchors. A
hash keeps 32 bits beyond its shard's number, so the share of blocks that are taken for
anchors by chance is the same at every size; such a block only adds windows to step 3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, shared_folder, stage, text_of, with_row_key
from stratum.llm.shingles import _mix, word_hashes

WINDOW = 35
#: Words that one shard of the hash space is meant to hold, and hashes sent by a task at a time.
SHARD_WORDS = 4_000_000
FLUSH = 2_000_000
#: Windows of one row of asked hashes.
ASK = 200_000
#: Bytes of text that are hashed together.
CHUNK = 1 << 20

_U = np.uint64
_WHITE = b" \t\n\x0b\x0c\r"


def _places(width: int, salt: int) -> np.ndarray:
    """Random odd factors of the words of a run."""
    return np.random.Generator(np.random.PCG64([width, salt])).integers(0, 1 << 64, width, dtype=np.uint64) | _U(1)


def _pieces(body: bytes):
    """A long text cut before white space, so that hashing it takes bounded memory."""
    start = 0
    while len(body) - start > CHUNK:
        cut = start + CHUNK
        while cut < len(body) and body[cut] not in _WHITE:
            cut += 1
        yield body[start:cut]
        start = cut
    yield body[start:]


def _hashed(bodies):
    """For runs of texts: their word hashes one after the other, and where each text's begin."""
    some, size = [], 0

    def hashed():
        if len(some) == 1 and size > CHUNK:
            words = np.concatenate([word_hashes(piece)[0] for piece in _pieces(some[0])])
            return words, np.array([0, len(words)])
        words, starts = word_hashes(b" ".join(some))
        return words, np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in some]))

    for body in bodies:
        if some and size + len(body) > CHUNK:
            yield hashed()
            some, size = [], 0
        some.append(body)
        size += len(body)
    if some:
        yield hashed()


def _run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` words at every place."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j, place in enumerate(_places(width, 0)):
        out += words[j:j + n] * place
    return _mix(out)


def _windows_at(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at ``starts``, of 64 and 32 bits."""
    a, b = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    for j, (p, q) in enumerate(zip(_places(width, 1), _places(width, 2), strict=True)):
        some = words[starts + j]
        a += some * p
        b += some * q
    return _mix(a), (_mix(b) >> _U(32)).astype(np.uint32)


def _blocks_and_runs(words, bounds, window: int, block: int, bits: int):
    """Of each place where a run fits into a text of a window or more: text, place in it, hash."""
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - bounds[text]
    fits = (place + block <= lengths[text]) & (lengths[text] >= window)
    runs = _run_hashes(words, block)
    fits = fits[:len(runs)]
    return text[:len(runs)][fits], place[:len(runs)][fits], runs[fits] >> _U(32 - bits)


def _bodies(column):
    return (v.as_py() for v in column)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_values)))


def _anchor_hashes(rows: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Step 1: ``hash`` of every block that stands at two places or more."""

    def send(batches):
        def packed(parts):
            values = np.sort(np.concatenate(parts))  # hash, then whether it is a block's
            hashes = values >> _U(1)
            first, count = _groups(hashes)
            is_block = (values[first + count - 1] & _U(1)).astype(bool)  # a block's comes last
            hashes, many = hashes[first], count > 1
            edges = np.searchsorted(hashes, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(32))
            some = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
            cut = [slice(edges[k], edges[k + 1]) for k in some]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([(hashes[c] & _U(0xFFFFFFFF)).astype("<u4").tobytes() for c in cut], pa.binary()),
                 pa.array([np.packbits(many[c]).tobytes() for c in cut], pa.binary()),
                 pa.array([np.packbits(is_block[c]).tobytes() for c in cut], pa.binary())],
                names=["shard", "hashes", "many", "blocks"])

        held, size = [], 0
        for batch in batches:
            for words, bounds in _hashed(_bodies(batch.column(0))):
                _, place, hashes = _blocks_and_runs(words, bounds, window, block, bits)
                for i in range(0, len(hashes), FLUSH):
                    held.append(hashes[i:i + FLUSH] << _U(1) | (place[i:i + FLUSH] % block == 0).astype(np.uint64))
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield packed(held)
                        held, size = [], 0
        if size:
            yield packed(held)

    def meet(key, table):
        values = []
        for hashes, many, blocks in zip(*(_bodies(table.column(c)) for c in ("hashes", "many", "blocks")), strict=True):
            hashes = np.frombuffer(hashes, dtype="<u4").astype(np.uint64)
            flags = [np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=len(hashes)).astype(np.uint64) for f in (many, blocks)]
            values.append(hashes << _U(2) | flags[0] << _U(1) | flags[1])
        values = np.sort(np.concatenate(values))
        first, count = _groups(values >> _U(2))
        flags = np.bitwise_or.reduceat(values & _U(3), first)
        found = (values[first] >> _U(2))[((count > 1) | (flags >= 2)) & (flags & _U(1) > 0)]
        return pa.table({"hash": pa.array(found.astype(np.int64) | (key[0].as_py() << 32), pa.int64())})

    sent = rows.select("body").mapInArrow(send, "shard int, hashes binary, many binary, blocks binary")
    return sent.groupBy("shard").applyInArrow(meet, "hash long")


def _anchors(rows: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Step 2: ``file, at, blocks``: the numbers of a document's blocks that are anchors."""

    def blocks(batches):
        for batch in batches:
            files, at, done = batch.column(0), batch.column(1), 0
            for words, bounds in _hashed(_bodies(batch.column(2))):
                text, place, hashes = _blocks_and_runs(words, bounds, window, block, bits)
                own = np.flatnonzero(place % block == 0)
                for i in range(0, len(own), FLUSH):
                    some = own[i:i + FLUSH]
                    which = pa.array(text[some] + done)
                    yield pa.RecordBatch.from_arrays(
                        [files.take(which), at.take(which), pa.array((place[some] // block).astype(np.int32)),
                         pa.array(hashes[some].astype(np.int64))], names=["file", "at", "number", "hash"])
                done += len(bounds) - 1

    every = rows.select("file", "at", "body").mapInArrow(blocks, "file long, at long, number int, hash long")
    return (every.join(stage(_anchor_hashes(rows, window, block, bits)), "hash", "left_semi")
            .groupBy("file", "at").agg(F.collect_list("number").alias("blocks")))


def _asked(rows: DataFrame, anchors: DataFrame, window: int, block: int) -> DataFrame:
    """Step 3: the windows around anchors, many to a row: document keys, starts and hashes as arrays of bytes."""
    names = ["batch", "files", "ats", "starts", "a", "b"]

    def near(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[list] = [[] for _ in names[1:]]
        size = 0

        def flush():
            nonlocal number, size
            joined = [np.concatenate(h) for h in held]
            for i in range(0, size, ASK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number])] + [pa.array([j[i:i + ASK].tobytes()], pa.binary()) for j in joined], names=names)
                number += 1
            size = 0
            for h in held:
                h.clear()

        for batch in batches:
            files, ats = (batch.column(k).to_numpy() for k in (0, 1))
            done = 0
            for words, bounds in _hashed(_bodies(batch.column(2))):
                for k in range(len(bounds) - 1):
                    blocks = np.asarray(batch.column(3)[done + k].as_py(), dtype=np.int64)
                    last = bounds[k + 1] - bounds[k] - window
                    starts = np.unique((blocks[:, None] * block - np.arange(block)[None, :]).ravel())
                    starts = starts[(starts >= 0) & (starts <= last)]
                    for h, v in zip(held, (np.full(len(starts), files[done + k]), np.full(len(starts), ats[done + k]),
                                           starts.astype(np.int32), *_windows_at(words, starts + bounds[k], window)), strict=True):
                        h.append(v)
                    size += len(starts)
                    if size >= ASK:
                        yield from flush()
                done += len(bounds) - 1
        if size:
            yield from flush()

    both = rows.join(anchors, ["file", "at"]).select("file", "at", "body", "blocks")
    return both.mapInArrow(near, "batch long, files binary, ats binary, starts binary, a binary, b binary")


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["a"], dtype="<u8"), np.frombuffer(row["b"], dtype="<u4")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the hashes, and the first place and length of each distinct one in it."""
    order = np.lexsort((b, a))
    new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(np.concatenate(([True], new)))
    return order, first, np.diff(np.append(first, len(a)))


def _spans(asked: DataFrame, window: int, bits: int) -> DataFrame:
    """Steps 3 and 4: ``file, at, spans``: the repeated windows of a document, overlapping ones joined."""
    edges_at = np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.empty(0, dtype=np.uint64)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _arrays(row)
                order, first, count = _distinct(a, b)
                a, b = a[order][first], b[order][first]
                edges = np.concatenate(([0], np.searchsorted(a, edges_at), [len(a)]))
                some = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
                cut = [slice(edges[k], edges[k + 1]) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()),
                     pa.array([a[c].tobytes() for c in cut], pa.binary()), pa.array([b[c].tobytes() for c in cut], pa.binary()),
                     pa.array([np.packbits(count[c] > 1).tobytes() for c in cut], pa.binary())],
                    names=["shard", "batch", "a", "b", "many"])

    def meet(key, table):
        parts = [(*_arrays(row), row["many"], row["batch"]) for row in table.to_pylist()]
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        many = np.concatenate([np.unpackbits(np.frombuffer(p[2], dtype=np.uint8), count=len(p[0])) for p in parts])
        order, first, count = _distinct(a, b)
        repeated = np.repeat((count > 1) | (np.maximum.reduceat(many[order], first) > 0), count)
        answer = np.empty(len(a), dtype=bool)
        answer[order] = repeated
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        return pa.table({"batch": pa.array([p[3] for p in parts], pa.int64()),
                         "shard": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "answer": pa.array([np.packbits(answer[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                         "size": pa.array(np.diff(cuts), pa.int64())})

    def mark(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _arrays(row)
                order, _, count = _distinct(a, b)
                answers = sorted((x["shard"], x["answer"], x["size"]) for x in row["answers"])
                repeated = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for _, x, n in answers]).astype(bool)
                hit = np.empty(len(a), dtype=bool)
                hit[order] = np.repeat(repeated, count)
                files, ats = (np.frombuffer(row[c], dtype="<i8")[hit] for c in ("files", "ats"))
                starts = np.frombuffer(row["starts"], dtype="<i4")[hit].astype(np.int64)
                if not len(starts):
                    continue
                # a document's windows stand together, in order: a span ends where the next window starts beyond it
                other = np.concatenate(([True], (files[1:] != files[:-1]) | (ats[1:] != ats[:-1]) | (starts[1:] > starts[:-1] + window)))
                head = np.flatnonzero(other)
                tail = np.append(head[1:], len(starts)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files[head]), pa.array(ats[head]), pa.array(starts[head]), pa.array(starts[tail] + window)],
                    names=["file", "at", "first", "behind"])

    asks = asked.select("batch", "a", "b").mapInArrow(send, "shard int, batch long, a binary, b binary, many binary")
    answers = asks.groupBy("shard").applyInArrow(meet, "batch long, shard int, answer binary, size long")
    answers = stage(answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "answer", "size")).alias("answers")))
    spans = asked.join(answers, "batch").select("files", "ats", "starts", "a", "b", "answers") \
        .mapInArrow(mark, "file long, at long, first long, behind long")
    return spans.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("first", "behind"))).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    shards: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept``.

    ``spans`` are the word ranges ``[first, behind)`` that go, ``kept`` the other words joined
    by single spaces. ``window`` is odd. ``shards`` (a power of two) is taken from the amount
    of text if not given.

    Defined cases: null text has no words; a text of fewer words than a window keeps them
    all; a null id stays null; rows that repeat an id are documents of their own (and each
    other's copies if their texts are equal); an empty table gives an empty result; further
    columns are ignored whatever their names.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    block = (window + 1) // 2
    rows = with_row_key(docs, doc_id=docs[id_col], body=text_of(docs, text_col).cast("binary"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        shards = 1 << max(3, int(size // 6 // SHARD_WORDS).bit_length())
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    bits = shards.bit_length() - 1
    root = shared_folder(docs.sparkSession)
    anchors = stage(_anchors(rows, window, block, bits), f"{root}/anchors")
    asked = stage(_asked(rows, anchors, window, block), f"{root}/asked")
    spans = stage(_spans(asked, window, bits), f"{root}/spans")
    id_type = docs.schema[id_col].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            done = size = 0
            for i, (body, some) in enumerate(zip(_bodies(batch.column(1)), _bodies(batch.column(2)), strict=True)):
                words = body.split()  # at the six ASCII white-space bytes
                n = len(words)
                if some:
                    left, kept = 0, []
                    for span in some:
                        kept += words[left:span["first"]]
                        left = max(left, span["behind"])
                    words = kept + words[left:]
                for col, value in zip(cols, (n, n - len(words), b" ".join(words)), strict=True):
                    col.append(value)
                size += len(body)
                if size > 8 * CHUNK or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done, len(cols[0])), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                         batch.column(2).slice(done, len(cols[0])), pa.array(cols[2], pa.binary())],
                        names=["doc_id", "n_words", "n_removed", "spans", "kept"])
                    done, size, cols = i + 1, 0, [[], [], []]

    out = rows.join(spans, ["file", "at"], "left").select("doc_id", "body", "spans")
    kind = "array<struct<first:bigint,behind:bigint>>"
    return out.mapInArrow(keep, f"doc_id {id_type}, n_words long, n_removed long, spans {kind}, kept binary") \
        .withColumn("kept", F.col("kept").cast("string"))


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS t(i)),
repeated AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM repeated, range(35) AS t(k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL) AS t, count(gone.i) AS n_removed
  FROM words LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
