"""Repeated passages by brute force over all windows, on odd texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratum.llm.common import with_row_key
from stratum.llm.substring_dedup import substring_dedup

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, file long, at long, body string, spans string, hash long, `_metadata` string"


def brute(texts, window):
    docs = [re.findall(WORD, t or "") for t in texts]
    seen = {}
    for d, words in enumerate(docs):
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i:i + window]), []).append((d, i))
    gone = {(d, i + k) for places in seen.values() if len(places) > 1 for d, i in places for k in range(window)}
    out = []
    for d, words in enumerate(docs):
        kept = [w for i, w in enumerate(words) if (d, i) not in gone]
        out.append((len(words), len(words) - len(kept), " ".join(kept)))
    return out


def texts():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdéß漢", k=rng.randint(1, 6))) for _ in range(300)]

    def say(n):
        return " ".join(rng.choices(vocab, k=n))

    passage, long = say(60), say(9000)
    out = [None, "", " \n", "one", say(34), say(35), say(36)]
    out += [passage, passage, passage + " tail", "head " + passage.replace(" ", "\n\t", 7), say(100) + " " + passage + " " + say(80)]
    out += [" ".join(passage.split()[a:a + 35]) for a in (0, 7, 25)]  # exact windows at any offset
    out += ["A" + passage, passage.upper(), long, say(13) + " " + long[2000:30000] + " " + say(5)]
    out += ["again " * 36, "again " * 35, "x y " * 40, say(50) + " " + passage + " mid " + passage]  # repeats inside one text
    out += [say(rng.randint(1, 120)) for _ in range(40)]
    out += [out[-1]] * 30 + ["w" * 200_000, passage.replace(" ", " ")]
    return out


@pytest.mark.parametrize("window,shards", [(35, None), (35, 1), (5, 16)])
def test_by_all_windows(spark, window, shards):
    data = texts()
    rows = [(None if k % 11 == 0 else k // 2, t, 7, 8, "b", "s", 9, "m") for k, t in enumerate(data)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = substring_dedup(docs, window=window, shards=shards).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(data, window), strict=True)]
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got))) == sorted(map(repr, want))
    for r in got:
        spans = [(s["first"], s["behind"]) for s in r["spans"] or []]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(b - a >= window for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_one_passage_in_most_documents(spark):
    """A passage that stands in every document, each with surroundings of its own."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(50))
    data = [f"{rng.random()} {rng.random()} {passage} {rng.random()}" for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(16)
    got = substring_dedup(docs).collect()
    assert len(got) == 3000 and {(r["n_words"], r["n_removed"]) for r in got} == {(53, 50)}


def test_odd_calls(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(none).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(none, window=4)
    with pytest.raises(ValueError):
        substring_dedup(none, shards=6)


def test_row_keys(spark, tmp_path):
    """Keys are unique and the same whichever columns are read, from files or not."""
    spark.range(1000).withColumn("text", F.lit("t")).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    a = {r["id"]: (r["file"], r["at"]) for r in with_row_key(docs, id=docs["id"]).collect()}
    b = {r["id"]: (r["file"], r["at"]) for r in with_row_key(docs.where("id >= 0"), id=docs["id"], text=docs["text"]).collect()}
    assert a == b and len(set(a.values())) == 1000
    made = spark.range(50)
    assert with_row_key(made, id=made["id"]).select("file", "at").distinct().count() == 50
