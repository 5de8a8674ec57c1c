"""Repairs by an exhaustive cheapest-first search, on random and odd conversations and a whole table."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from stratum.llm.conversation_repair import SYMBOLS, Tables, op11_conversation_repair, repair_conversations
from tests.conftest import SF01

SCHEMA = "conv_id long, turn long, role string, text string, seg int, place long, kind int, key string, audit string, row long, fault string"
WORD = r"[^\x20\x09-\x0D]"
GOAL, PREFIX = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Cost, audit and repaired rows by a search over (rows read, initials given); rows: role, text, must go, truncated."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, given, out = heapq.heappop(heap)
        if (i, given) in seen:
            continue
        seen.add((i, given))
        if i == len(rows) and GOAL.fullmatch(given):
            return cost, audit, [x for x in out]
        steps = [(2, "I", i, c, ((NAMES[c], ""),)) for c in "ua"] if len(given) < 2 * len(rows) + 4 else []
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            steps.append((3, "D", i + 1, "", ()))
            if not must_go:
                steps.append((truncated, "K", i + 1, role[:1] or "?", ((role, text),)))
                steps += [(2 + truncated, "R", i + 1, c, ((NAMES[c], text),)) for c in "ua"]
        for c, letter, j, initial, line in steps:
            if PREFIX.fullmatch(given + initial):
                heapq.heappush(heap, (cost + c, audit + letter, j, given + initial, out + line))


def brute(rows):
    """The report of one conversation's rows ``(turn, role, text)`` in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(WORD, text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                      "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, out = cheapest([(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(rows, faults, strict=True)])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()), out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], " " if r[2] is None else r[2]))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_blocks_equal_single_rows(block):
    t, plain, rng = Tables(block), Tables(1), random.Random(block)
    for n in [*range(12), 100]:
        symbols = rng.choices(range(SYMBOLS), k=n)
        vector, total, behind = t.costs(symbols)
        assert (vector, total) == plain.costs(symbols)[:2]
        edits, states, last = t.trace(symbols, behind)
        assert (edits, states, last) == plain.trace(symbols, plain.costs(symbols)[2])
        cut = rng.randint(0, n)  # two segments do what the whole does
        (v2, a2, s2), (v1, a1, s1) = t.segment(symbols[cut:]), t.segment(symbols[:cut])
        assert v1[v2[0]] == vector and a2[0] + a1[v2[0]] == total
        assert s2[0][s1[v2[0]][0]] == last


def conversations():
    rng = random.Random(5)
    texts = ["Hello there.", "no end", "", " \t\n", "What?", "Done! \n", None, "ok.", "x" * 3000 + ".", "漢字。", "a. b"]
    roles = ["system", "user", "assistant", "tool", None, "", "User", "user", "assistant"]
    out = {}
    for conv in [None, *range(60)]:
        out[conv] = [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
    out[100] = [(k, ("user", "assistant")[k % 2], f"turn {k}{'.' if k % 7 else ''}") for k in range(500)]
    out[101] = [(None, None, None)]
    out[102] = [(3, "user", "Same.")] * 9
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_by_search(spark, partitions):
    convs = conversations()
    flat = [(c, t, r, x, 1, 2, 3, "k", "a", 5, "f") for c, rows in convs.items() for t, r, x in rows]
    random.Random(partitions).shuffle(flat)
    df = spark.createDataFrame(flat, SCHEMA).repartition(4)
    want = {c: brute(in_order(rows)) for c, rows in convs.items() if c != 100}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in repair_conversations(df, partitions=partitions).collect()}
    assert len(got) == len(convs)
    assert {c: v for c, v in got.items() if c != 100} == {c: w[0] for c, w in want.items()}
    assert got[100][:7] == (0, 0, 0, 72, 0, 72, "K" * 500)
    lines = {}
    for r in repair_conversations(df, rows=True, partitions=partitions).orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: v for c, v in lines.items() if c != 100} == {c: w[1] for c, w in want.items() if w[1]}
    assert [x for _, x in lines[100]] == [x for _, _, x in convs[100]]


def test_whole_table(spark):
    """The registered query on the whole table, with the contract's damage done here by hand."""
    rows = {}
    for r in spark.read.parquet(f"{SF01}/conversations.parquet").collect():
        code = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", r["text"])}.get(code, r["text"])
        kept = [(r["turn"], "user" if code == 4 else r["role"], text)] * {0: 0, 3: 2}.get(code, 1)
        rows.setdefault(r["conv_id"], []).extend(kept)
    got = op11_conversation_repair(spark, SF01).collect()
    assert {tuple(r) for r in got} == {(c, *brute(in_order(x))[0]) for c, x in rows.items()} and len(got) == len(rows)


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
