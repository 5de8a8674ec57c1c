"""Operator 4's search step: links that no list head shows, blocks of a pot, rows of a group that does not link."""

import random

from stratum.llm import ngram_join
from stratum.llm.ngram_join import ngram_components
from tests.llm.test_small_cases import brute_components, order, sentence


def _variants(n, seed, edits, words=110):
    """Texts of one origin, each with its own words changed; some have a companion of one more change."""
    rng, origin, out = random.Random(seed), sentence(words, seed).split(), []
    for k in range(n):
        text = list(origin)
        for place in rng.sample(range(words), rng.choice(edits)):
            text[place] = f"w{seed}v{k}p{place}"
        out.append(" ".join(text))
        if k % 5 == 0:
            text[rng.randrange(words)] = "companion"
            out.append(" ".join(text))
    return out


def test_links_found_in_pots_of_many_blocks(spark, monkeypatch):
    """Every block pair is searched: without star links, all links come from the pots."""
    texts = _variants(30, 11, (3, 4, 5)) + _variants(20, 12, (1, 2, 6)) + [sentence(80, 13)]
    pairs = list(enumerate(texts))
    random.Random(4).shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "_star_links", lambda lists, heads, sets, percent: spark.createDataFrame([], "u long, v long"))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()]
    want = brute_components(pairs)
    assert order(got) == order(want)
    assert 1 < len({w[2] for w in want}) < len(want) - 6


def test_rows_of_a_group_without_links(spark, monkeypatch):
    """Variants that share most shingles but do not link go to a pot once each."""
    texts = _variants(60, 21, (4, 5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    seen, pots = [], ngram_join._pots
    monkeypatch.setattr(ngram_join, "_pots", lambda lists, *more: seen.append((lists, pots(lists, *more))) or seen[-1][1])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()]
    want = brute_components(list(enumerate(texts)))
    assert order(got) == order(want)
    [(lists, near)] = seen
    n = near.count()
    assert n == near.select("pot", "cid").distinct().count()
    assert n < lists.count() / 4
