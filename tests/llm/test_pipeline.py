"""The corpus pipeline's stages against brute force on the smallest documents table."""

import hashlib
import re

import pytest

import corpus_pipeline as P
from stratum.llm.common import read_table, stage
from tests.conftest import SF001
from tests.llm.test_small_cases import SCHEMA, brute_measures, rows, shingles, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run_stage(spark, k, docs):
    return stage(P.STAGES[k][1](spark, docs, SF001))


@pytest.fixture(scope="module")
def tables(spark):
    """The documents and the result of every stage on its predecessor's."""
    out = [read_table(spark, SF001, "documents")]
    for k in range(len(P.STAGES)):
        out.append(run_stage(spark, k, out[-1]))
    return out


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources",
                                        "byte-level BPE"]


def test_columns_stay(tables):
    for t in tables[:-1]:
        assert t.columns == COLUMNS


def test_quality(tables):
    before = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    kept = {r["doc_id"] for r in tables[1].collect()}
    for i, text in before.items():
        n, _, symbols, _, repeated = brute_measures(text)
        if n < 20 or 100 * repeated > 30 * n or 10 * symbols > n:
            assert i not in kept
    assert len(kept) > len(before) / 2


def test_exact(tables):
    groups = {}
    for r in tables[1].collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in tables[2].collect()) == sorted(map(min, groups.values()))


def test_near(tables):
    docs = {r["doc_id"]: shingles(r["text"]) for r in tables[2].collect()}
    comp = {i: i for i in docs}
    links = [(a, b) for a in docs for b in docs if a < b and docs[a] and docs[b]
             and 100 * len(docs[a] & docs[b]) >= 80 * len(docs[a] | docs[b])]
    for _ in docs:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert sorted(r["doc_id"] for r in tables[3].collect()) == sorted(i for i in docs if comp[i] == i)
    assert links


def test_mix(tables):
    before = {r["doc_id"]: r for r in tables[3].collect()}
    times, taken = {}, {}
    for r in tables[4].collect():
        assert r == before[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    assert max(times.values()) <= 3
    whole = sum(len(words(r["text"])) for r in before.values())
    longest = max(len(words(r["text"])) for r in before.values())
    assert abs(sum(taken.values()) - whole) <= longest * (len(taken) + 1)


def test_tokens(tables):
    texts = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in tables[4].collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in tables[5].collect()) == texts


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, clashing columns; and empty tables."""
    odd = spark.createDataFrame(rows(), SCHEMA)
    for docs in (odd, odd.limit(0)):
        for k, (name, _) in enumerate(P.STAGES):
            alone = run_stage(spark, k, docs)
            if k < 4:
                assert alone.columns == docs.columns
                assert alone.count() <= 3 * docs.count()
    kept = run_stage(spark, 1, odd)
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})
    near = run_stage(spark, 2, odd)
    assert {r["doc_id"] for r in near.collect()} >= {3, 4, 5, 15}  # without words: linked with nothing


def test_empty_and_odd_tables(spark):
    """Every stage on no rows, and the filter stages on nulls, ties, repeated rows and clashing columns."""
    none = spark.createDataFrame([], SCHEMA)
    for k in range(len(P.STAGES)):
        out = run_stage(spark, k, none)
        assert out.count() == 0 and (k == len(P.STAGES) - 1 or out.columns == none.columns)
    odd = stage(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    for k in (1, 2):
        out = run_stage(spark, k, odd)
        assert out.columns == odd.columns and out.exceptAll(odd).isEmpty()
        texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
        assert k == 2 or len(texts) == len(set(texts))
