"""Pages that are deep, wide or badly quoted; url rules of four tokens."""

import random

from stratum.llm.html_wrappers import _align_long, align, extract_pages, parse, wrapper_of
from stratum.llm.url_rules import judge_urls, mine_rules

import operator


def pages(spark, bodies):
    rows = [(k, f"http://h{k}.example.org/a/{k}", b) for k, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_deep_and_wide_pages(spark):
    deep = "<article><p>Start here.</p>" + "<font>" * 5000 + "Inner words." + "</font>" * 5000 + "<p>The end.</p></article><nav>Menu</nav>"
    unclosed = "<article>" + "<font><b>" * 1200 + "Lost and found."
    wide = "<article>" + "".join(f"<{random.Random(k).choice(['p', 'h2', 'h3', 'pre', 'ol'])} id=x{chr(97 + k % 26)}>Line {k}.</p>" for k in range(20_000)) + "</article>"
    got = pages(spark, [deep, unclosed, wide])
    assert got[0] == "Start here.\nInner words.\nThe end."
    assert got[1] == "Lost and found."
    assert got[2].split("\n") == [f"Line {k}." for k in range(20_000)]


def test_stray_quotes(spark):
    got = pages(spark, ["""<article><p><a href="x"">link</a> and "more" text</p></article>""",
                        """<article><p><a title=it's>link</a> don't stop</p></article>""",
                        """<article><p title="a > b" class='c'>kept</p><img alt="x>y"><p>"quoted" = 'both'</p></article>"""])
    assert got == {0: 'link and "more" text', 1: "link don't stop", 2: "kept\n\"quoted\" = 'both'"}


def test_long_lists_align_like_short_ones():
    rng = random.Random(3)
    for _ in range(50):
        a = wrapper_of(parse("".join(f"<t{k}>x</t{k}>" for k in rng.sample(range(30), 12))))
        b = [x for x in a if rng.random() < 0.8] + wrapper_of(parse("<z>y</z>"))
        assert [(x[0], x[1]) for x in _align_long(a, b, operator.add)] == [(x[0], x[1]) for x in align(a, b)]


def test_rule_of_four_tokens(spark):
    """Bad only where four tokens meet; no three of them are a rule."""
    rng, rows = random.Random(4), []
    names = ["a", "b", "c", "d"]
    for k in range(1200):
        have = [n for n in names if rng.random() < 0.75]
        bad = len(have) == 4
        rows.append((k, f"http://s.test/{'/'.join(['x', *have])}", int(not bad)))
    urls = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in judge_urls(urls, labels, fixed=()).collect()}
    assert all((got[k]["verdict"] == "block") == (q == 0) for k, _, q in rows)
    assert {r["method_rule"] for r in got.values() if r["method_rule"]} == {"path:a & path:b & path:c & path:d"}


def test_implied_rules_go(spark):
    rows = [(["p", "q", "r", "s"], True)] * 30 + [(["q", "r", "s"], False)] * 30 + [(["p"], True)] * 30
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert [r["tokens"] for r in rules.collect()] == [["p"]]
