"""Operator 11: repair of conversation structure by Four-Russians block tables.

A conversation is repaired by the cheapest edits that make its roles read ``(s?(ua)+)?`` by
their initials. What a row costs depends on little: its initial, whether it is truncated,
whether it must go. These nine symbols and the four states of the grammar give a vector of
costs to go at every row; less its least entry, only some dozens of vectors occur. For
every such vector and every block of ``BLOCK`` symbols the vector before the block and what
it adds are computed once per worker, so a conversation's costs are found from its end by a
lookup a block. The edits are then traced from the first row on, each block expanded row by
row: going against the order in which costs were found, the least edit letter that keeps to
the least cost can be taken at once, so ties fall to the first audit string.

Rows are range-partitioned by conversation and turn, so a conversation of any length is
dealt over many tasks. One that lies within a task is finished there. Of others each task
gives a segment: what it does to every vector and state. The segments of a conversation, a
row per task that holds some of it, are put together, and each is then traced alone. Only
the digest of a whole conversation must be fed in order, row by row.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, stage

#: Symbols of a block: 9^4 blocks.
BLOCK = 4
#: A row's symbol is twice its initial (s, u, a, other), one more if it is truncated; or this.
MUST_GO = 8
SYMBOLS = 9
#: States: nothing yet, after s, after u, after a; the initial that must come next and its state.
NEXT_STATE, NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: States that a kept initial leads to.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Costs to go at the end: a whole pair is missing after s, an answer after u.
AT_END = (0, 4, 2, 0)
END_EDITS = ("", "II", "I", "")
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _row_edits(symbol: int, state: int) -> list[tuple[int, str, int]]:
    """What may be done with a row in a state, without inserts: cost, letter, state after it."""
    edits = [(DELETE, "D", state)]
    if symbol != MUST_GO:
        extra = TRUNCATED * (symbol % 2)
        if (state, symbol // 2) in KEPT:
            edits.append((KEEP + extra, "K", KEPT[state, symbol // 2]))
        edits.append((REROLE + extra, "R", NEXT_STATE[state]))
    return edits


def _costs_before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, from those after it."""
    costs = [min(c + after[t] for c, _, t in _row_edits(symbol, s)) for s in range(4)]
    for _ in range(2):  # two inserts lead everywhere an insert can lead
        costs = [min(costs[s], INSERT + costs[NEXT_STATE[s]]) for s in range(4)]
    return tuple(costs)


def _least_edits(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least letters of least cost for a row (inserts, then its own edit), and the state after it."""
    costs, letters = _costs_before(symbol, after), ""
    while True:
        best = [(e, t) for c, e, t in _row_edits(symbol, state) if c + after[t] == costs[state]]
        if INSERT + costs[NEXT_STATE[state]] == costs[state]:
            best.append(("I", None))
        letter, then = min(best, key=lambda x: x[0])
        letters += letter
        if then is not None:
            return letters, then
        state = NEXT_STATE[state]


class Tables:
    """All cost vectors that occur, less their least entry, and what rows and blocks make of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.ids = [AT_END], {AT_END: 0}
        steps, adds = [], []
        for vector in self.vectors:  # grows while it is read
            steps.append([])
            adds.append([])
            for symbol in range(SYMBOLS):
                costs = _costs_before(symbol, vector)
                least = min(costs)
                costs = tuple(c - least for c in costs)
                if costs not in self.ids:
                    self.ids[costs] = len(self.vectors)
                    self.vectors.append(costs)
                steps[-1].append(self.ids[costs])
                adds[-1].append(least)
        self.step, self.add = np.array(steps, dtype=np.int32), np.array(adds, dtype=np.int64)
        self.edits = [[[_least_edits(x, v, s) for s in range(4)] for x in range(SYMBOLS)] for v in self.vectors]
        self.state_after = np.array([[[e[1] for e in row] for row in v] for v in self.edits], dtype=np.int8)
        n = len(self.vectors)
        self.block_step = np.repeat(np.arange(n, dtype=np.int32)[:, None], SYMBOLS ** block, axis=1)
        self.block_add = np.zeros((n, SYMBOLS ** block), dtype=np.int64)
        codes = np.arange(SYMBOLS ** block)
        for place in range(block):  # the last symbol of a block is its lowest digit
            symbol = (codes // SYMBOLS ** place % SYMBOLS)[None, :]
            self.block_add += self.add[self.block_step, symbol]
            self.block_step = self.step[self.block_step, symbol]
        # plain lists answer single lookups faster
        self.steps, self.block_steps, self.block_adds = self.step.tolist(), self.block_step.tolist(), self.block_add.tolist()
        self.adds = self.add.tolist()

    def blocks(self, symbols: list[int]) -> tuple[int, list[int]]:
        """Rows before the first whole block, and the blocks' codes."""
        head = len(symbols) % self.block
        codes = []
        for i in range(head, len(symbols), self.block):
            code = 0
            for symbol in symbols[i:i + self.block]:
                code = code * SYMBOLS + symbol
            codes.append(code)
        return head, codes

    def costs(self, symbols: list[int], end: int = 0) -> tuple[int, int, list[int]]:
        """The vector before all rows, what the rows add, and the vector behind each block and the head."""
        head, codes = self.blocks(symbols)
        vector, total, behind = end, 0, [end]
        for code in reversed(codes):
            total += self.block_adds[vector][code]
            vector = self.block_steps[vector][code]
            behind.append(vector)
        for symbol in reversed(symbols[:head]):
            total += self.adds[vector][symbol]
            vector = self.steps[vector][symbol]
        return vector, total, behind[::-1]

    def trace(self, symbols: list[int], behind: list[int], state: int = 0) -> tuple[list[str], list[int], int]:
        """The edits of every row, the state before each, and the last state; blocks are expanded one by one."""
        head = len(symbols) % self.block
        starts = ([0] if head else []) + list(range(head, len(symbols), self.block))
        edits, states = [], []
        for start, vector in zip(starts, behind if head else behind[1:], strict=True):
            some = symbols[start:start + self.block if start or not head else head]
            after = [vector]
            for symbol in reversed(some[1:]):
                after.append(self.steps[after[-1]][symbol])
            for symbol, vector_after in zip(some, reversed(after), strict=True):
                letters, then = self.edits[vector_after][symbol][state]
                edits.append(letters)
                states.append(state)
                state = then
        return edits, states, state

    def segment(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the rows make of every vector: the vector before them, what they add, and the states
        that each of the four states before them comes to."""
        n = len(self.vectors)
        head, codes = self.blocks(symbols)
        vectors, total = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
        behind = [vectors]
        for code in reversed(codes):
            total += self.block_add[vectors, code]
            vectors = self.block_step[vectors, code]
            behind.append(vectors)
        states = np.tile(np.arange(4, dtype=np.int8), (n, 1))

        def forward(some, vector):
            after = [vector]
            for symbol in reversed(some[1:]):
                after.append(self.step[after[-1], symbol])
            now = states
            for symbol, vector_after in zip(some, reversed(after), strict=True):
                now = self.state_after[vector_after[:, None], symbol, now]
            return now

        before = behind.pop()
        if head:
            for symbol in reversed(symbols[:head]):
                total += self.add[vectors, symbol]
                vectors = self.step[vectors, symbol]
            states = forward(symbols[:head], before)
        for i in range(head, len(symbols), self.block):
            states = forward(symbols[i:i + self.block], behind.pop())
        return vectors, total, states


@functools.lru_cache(maxsize=2)
def tables(block: int = BLOCK) -> Tables:
    """The tables, once for each Python worker."""
    return Tables(block)


def repaired_lines(edits: str, state: int, role: str, text: str) -> list[tuple[str, str]]:
    """Role and text of the rows that one row's edits leave."""
    out = []
    for letter in edits:
        if letter == "I":
            out.append((NEXT_ROLE[state], ""))
            state = NEXT_STATE[state]
        elif letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append((NEXT_ROLE[state], text))
    return out


def turn_faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with null role and text as one space, their order, initial and first fault; one table in the shared folder is written.

    A row is a duplicate if the same role and text stand earlier in its conversation. The
    first of each is an aggregate, joined back as a table of its own, so one text that
    fills a third of a conversation of any size is split.
    """
    space = F.lit(" ")
    base = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
        F.coalesce(turns[role_col].cast("string"), space).alias("role"),
        F.coalesce(turns[text_col].cast("string"), space).alias("text"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    ident = F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.length(conv).cast("string"), conv,
                        F.length("role").cast("string"), F.col("role"), F.col("text"))
    rows = stage(base.select("*", F.unhex(F.sha2(ident, 256)).alias("key"), F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
                  .where("copies > 1").select("key", F.col("first.row").alias("first")))
    body = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    fault = (F.when(body == "", BLANK_FAULT).when(F.col("first") != F.col("row"), DUPLICATE_FAULT)
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0))
    return rows.join(first, "key", "left").select(
        "conv_id", "turn", "role", "text", "key", "row", fault.alias("fault"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"))


#: Columns of the first pass besides conv_id: reports of finished conversations, segments, and rows of others.
_REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_SEGMENT = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.int32()), ("last_initial", pa.int32()),
            ("turns", pa.int64()), ("vectors", pa.list_(pa.int32())), ("adds", pa.list_(pa.int64())), ("states", pa.list_(pa.int8()))]
_ROW = [("role", pa.string()), ("text", pa.string()), ("symbol", pa.int32())]
_FIELDS = [("kind", pa.int32()), ("seg", pa.int32()), ("place", pa.int64()), *_REPORT, *_SEGMENT, *_ROW]
_FIELDS_DDL = ("kind int, seg int, place long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "audit string, repaired_sha256 string, first_turn long, last_turn long, first_initial int, last_initial int, "
               "turns long, vectors array<int>, adds array<long>, states array<tinyint>, role string, text string, symbol int")
REPORT_KIND, SEGMENT_KIND, OPEN_ROW, REPAIRED_ROW = range(4)


def _numbers(rows: list[tuple]) -> dict:
    """Counts of some adjacent rows ``(turn, role, text, fault, initial)`` of a conversation."""
    faults = [r[3] for r in rows]
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[4] for r in rows]
    return {"blank": faults.count(BLANK_FAULT), "duplicate": faults.count(DUPLICATE_FAULT),
            "truncated": faults.count(TRUNCATED_FAULT),
            "illegal": sum(pair not in _LEGAL for pair in itertools.pairwise(initials)),
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "turns": len(set(known)), "first_initial": initials[0], "last_initial": initials[-1]}


def _symbols(rows: list[tuple]) -> list[int]:
    return [MUST_GO if r[3] in (BLANK_FAULT, DUPLICATE_FAULT) else 2 * r[4] + (r[3] == TRUNCATED_FAULT) for r in rows]


def _all_lines(rows, edits, states, last: int | None) -> list[tuple[str, str]]:
    """The repaired rows; ``last`` is the state at the conversation's end, where it is reached."""
    lines = [line for r, e, s in zip(rows, edits, states, strict=True) for line in repaired_lines(e, s, r[1], r[2])]
    return lines if last is None else lines + repaired_lines(END_EDITS[last], last, "", "")


def _finished(rows: list[tuple]) -> tuple[dict, list[tuple[str, str]]]:
    """The report and the repaired rows of a whole conversation."""
    t, symbols = tables(), _symbols(rows)
    vector, total, behind = t.costs(symbols)
    edits, states, last = t.trace(symbols, behind)
    lines, numbers = _all_lines(rows, edits, states, last), _numbers(rows)
    gaps = numbers["last_turn"] - numbers["first_turn"] + 1 - numbers["turns"] if numbers["turns"] else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    report = {k: numbers[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    return {**report, "gaps": gaps, "cost": total + t.vectors[vector][0], "audit": "".join(edits) + END_EDITS[last],
            "repaired_sha256": digest}, lines


def _first_pass(keep_rows: bool):
    """A task's conversations: the first and the last may go on elsewhere, the others are finished here."""

    def run(batches):
        id_type = [None]

        def emit(records):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in records], id_type[0])]
                + [pa.array([r[1].get(name) for r in records], kind) for name, kind in _FIELDS],
                names=["conv_id", *(name for name, _ in _FIELDS)])

        def open_one(conv, rows, seg):
            vectors, adds, states = tables().segment(_symbols(rows))
            yield conv, {"kind": SEGMENT_KIND, "seg": seg, **_numbers(rows), "vectors": vectors.tolist(),
                         "adds": adds.tolist(), "states": states.ravel().tolist()}
            for place, (row, symbol) in enumerate(zip(rows, _symbols(rows), strict=True)):
                yield conv, {"kind": OPEN_ROW, "seg": seg, "place": place, "role": row[1], "text": row[2], "symbol": symbol}

        def done_one(conv, rows, seg):
            report, lines = _finished(rows)
            if not keep_rows:
                yield conv, {"kind": REPORT_KIND, **report}
            for place, (role, text) in enumerate(lines if keep_rows else ()):
                yield conv, {"kind": REPAIRED_ROW, "seg": seg, "place": place, "role": role, "text": text}

        conv, rows, seg, first = None, [], None, True
        out: list = []
        for batch in batches:
            id_type[0] = batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, part, *row in zip(*columns, strict=True):
                if rows and conv_id != conv:
                    out += (open_one if first else done_one)(conv, rows, seg)
                    rows, first = [], False
                    if len(out) > 2000:
                        yield emit(out)
                        out = []
                conv, seg = conv_id, part
                rows.append(tuple(row))
            if len(out) > 200:
                yield emit(out)
                out = []
        if rows:
            out += open_one(conv, rows, seg)
        for i in range(0, len(out), 2000):
            yield emit(out[i:i + 2000])

    return run


def _put_together(segments: DataFrame) -> DataFrame:
    """Each segment's vector behind it and state before it, with the sums of its conversation.

    A conversation has a segment per task that holds some of it, so a group is small."""
    columns = ["conv_id", "seg", "end", "state", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ddl = (f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, seg int, end int, state int, last boolean, gaps long, "
           "blank long, duplicate long, truncated long, illegal long, cost long")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("seg").to_dict("records")
        end, total, ends = 0, 0, []
        for p in reversed(parts):
            ends.append(end)
            total += int(p["adds"][end])
            end = int(p["vectors"][end])
        state, states = 0, []
        for p, behind in zip(parts, reversed(ends), strict=True):
            states.append(state)
            state = int(p["states"][4 * behind + state])
        sums = {k: sum(int(p[k]) for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        sums["illegal"] += sum((int(a["last_initial"]), int(b["first_initial"])) not in _LEGAL for a, b in itertools.pairwise(parts))
        known = [(int(p["first_turn"]), int(p["last_turn"])) for p in parts if p["turns"]]
        sums["turns"] -= sum(a[1] == b[0] for a, b in itertools.pairwise(known))
        gaps = known[-1][1] - known[0][0] + 1 - sums.pop("turns") if known else 0
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[0], "seg": [p["seg"] for p in parts], "end": ends[::-1], "state": states,
                             "last": [False] * (len(parts) - 1) + [True], "gaps": gaps, **{k: v for k, v in sums.items() if k != "turns"},
                             "cost": total + tables().vectors[end][0]})[columns]

    # turns are whole numbers or null, so they travel as nullable numbers
    return segments.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_turn", "last_turn")}) \
        .groupBy("conv_id").applyInPandas(run, ddl)


def _traced(rows: DataFrame) -> DataFrame:
    """The edits and repaired rows of every segment: rows come by segment and place."""
    ddl = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, seg int, place long, audit string, "
           "roles array<string>, texts array<string>")
    names = ["conv_id", "seg", "place", "audit", "roles", "texts"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        held, kind = [], None

        def flush():
            t = tables()
            symbols = [r[5] for r in held]
            edits, states, last = t.trace(symbols, t.costs(symbols, held[0][6])[2], held[0][7])
            cols: list[list] = [[] for _ in names]
            for k, (r, e, s) in enumerate(zip(held, edits, states, strict=True)):
                lines = repaired_lines(e, s, r[3], r[4])
                if held[0][8] and k == len(held) - 1:
                    e, lines = e + END_EDITS[last], lines + repaired_lines(END_EDITS[last], last, "", "")
                for col, v in zip(cols, (r[0], r[1], r[2], e, [x[0] for x in lines], [x[1] for x in lines]), strict=True):
                    col.append(v)
            for i in range(0, len(held), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 2000], t) for c, t in zip(cols, [kind, *types], strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:2] != held[0][:2]:
                    yield from flush()
                    held.clear()
                held.append(row)
        if held:
            yield from flush()

    return rows.mapInArrow(run, ddl)


def _digests(lines: DataFrame) -> DataFrame:
    """Digest of the repaired rows of each conversation; rows come in order and none is held."""
    ddl = f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches):
        conv, digest, empty, kind = None, None, True, None
        done: list = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, roles, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest is None or conv_id != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, empty = conv_id, hashlib.sha256(), True
                for role, text in zip(roles, texts, strict=True):
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
        if digest is not None:
            done.append((conv, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])],
                                             names=["conv_id", "repaired_sha256"])

    return lines.mapInArrow(run, ddl)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", rows: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``; with ``rows`` the repaired rows instead: ``conv_id, place, role, text``, where
    ``place`` orders a conversation's rows.

    Defined cases: null role or text is one space (so a null text is blank); null ids are one
    conversation; null turns come first; rows of one turn are taken by role, then text (by its
    first 64 characters, then by digest), equal rows one after the other, all but the first of
    them duplicates; an empty table gives an empty result; further columns are ignored whatever
    their names. ``partitions``: tasks that rows are dealt to (Spark's shuffle setting if not given).
    """
    spark = turns.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), "key", "row"]
    ordered = turn_faults(turns, conv_col, turn_col, role_col, text_col) \
        .repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .select("conv_id", F.spark_partition_id().alias("seg"), "turn", "role", "text", "fault", "initial")
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    found = stage(ordered.mapInArrow(_first_pass(rows), f"conv_id {id_type}, {_FIELDS_DDL}"))
    linked = stage(_put_together(found.where(F.col("kind") == SEGMENT_KIND)))
    here = found.where(F.col("kind") == OPEN_ROW).alias("r")
    # two segments a task at most
    both = here.join(F.broadcast(linked.alias("l")), F.expr("r.conv_id <=> l.conv_id and r.seg = l.seg")) \
        .select("r.conv_id", "r.seg", "r.place", "r.role", "r.text", "r.symbol", "l.end", "l.state", "l.last")
    traced = stage(_traced(both.repartition(parts, "conv_id", "seg").sortWithinPartitions("conv_id", "seg", "place")))
    place = F.expr("shiftleft(cast(seg as bigint), 40) + place * 4")
    if rows:
        more = traced.select("conv_id", place.alias("place"), F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "line")) \
            .select("conv_id", F.expr("place + at").alias("place"), "line.roles", "line.texts").toDF("conv_id", "place", "role", "text")
        return found.where(F.col("kind") == REPAIRED_ROW).select("conv_id", place.alias("place"), "role", "text").unionByName(more)
    names = ["conv_id", *(name for name, _ in _REPORT)]
    pieces = traced.groupBy("conv_id", "seg").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    audits = pieces.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    digests = _digests(traced.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg", "place")
                       .select("conv_id", "roles", "texts"))
    open_ones = linked.where("last").drop("seg", "end", "state", "last").alias("n") \
        .join(audits.alias("a"), F.expr("n.conv_id <=> a.conv_id")).join(digests.alias("d"), F.expr("n.conv_id <=> d.conv_id")) \
        .select("n.*", "a.audit", "d.repaired_sha256")
    return found.where(F.col("kind") == REPORT_KIND).select(*names).unionByName(open_ones.select(*names))


def damage_code(conv: Column, turn: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    return F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20


def damaged(turns: DataFrame) -> DataFrame:
    """The turns as the contract of ``op11_conversation_repair`` damages them."""
    code = damage_code(F.col("conv_id"), F.col("turn"))
    text = F.coalesce("text", F.lit(" "))
    text = (F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    rows = turns.select("conv_id", "turn", "role", "text", code.alias("code")).where("code != 0")
    times = F.when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    report = repair_conversations(damaged(turns))
    every = turns.select("conv_id").distinct().alias("c")
    zeros = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name, kind in _REPORT if kind == pa.int64()]
    return every.join(report.alias("r"), F.expr("c.conv_id <=> r.conv_id"), "left").select(
        "c.conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The repair row by row, the cheapest and first audit of every state kept; CRC-32 bit by bit.
OP11_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM src)),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS code
  FROM src),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS rep FROM crc),
o AS (
  SELECT cid, turn, role, text, substr(role, 1, 1) AS ini,
         row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, rep) AS i,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, rep) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
edits(s, op, ini, t, c, role) AS (
  SELECT s, 'D', CAST(NULL AS VARCHAR), s, 3, CAST(NULL AS VARCHAR) FROM range(4) AS x(s)
  UNION ALL VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
    (2, 'K', 'a', 3, 0, NULL), (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'),
    (3, 'R', NULL, 2, 2, 'user')),
inserts(s, t, c, op, lines) AS (
  SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM range(4) AS x(s)
  UNION ALL VALUES (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']),
    (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
best(cid, i, s, cost, audit, lines) AS (
  SELECT DISTINCT o.cid, CAST(0 AS BIGINT), CAST(n.t AS BIGINT), CAST(n.c AS BIGINT), n.op, n.lines FROM o, inserts n WHERE n.s = 0
  UNION ALL
  SELECT cid, i, s, cost, audit, lines FROM (
    SELECT b.cid, o.i, CAST(n.t AS BIGINT) AS s, b.cost + e.c + n.c + CASE WHEN o.fault = 3 AND e.op <> 'D' THEN 1 ELSE 0 END AS cost,
           b.audit || e.op || n.op AS audit,
           list_concat(b.lines, CASE WHEN e.op = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(e.role, o.role) || ':' || o.text] END, n.lines) AS lines
    FROM best b JOIN o ON o.cid = b.cid AND o.i = b.i + 1 JOIN edits e ON e.s = b.s JOIN inserts n ON n.s = e.t
    WHERE (e.ini IS NULL OR e.ini = o.ini) AND (e.op = 'D' OR o.fault NOT IN (1, 2)))
  QUALIFY row_number() OVER (PARTITION BY cid, s ORDER BY cost, audit) = 1),
whole AS (
  SELECT cid, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated FROM o GROUP BY cid),
pairs AS (
  SELECT cid, count(*) AS illegal FROM (SELECT cid, lag(ini) OVER (PARTITION BY cid ORDER BY i) || ini AS p FROM o)
  WHERE p NOT IN ('su', 'ua', 'au') GROUP BY cid),
final AS (
  SELECT b.* FROM best b JOIN whole w ON w.cid = b.cid AND w.n = b.i WHERE b.s IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.cid ORDER BY cost, audit) = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN whole USING (cid) LEFT JOIN pairs USING (cid) LEFT JOIN final USING (cid)
"""
