"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stratum.llm.bpe import encode, encode_documents, rank_file
from stratum.llm.components import components
from stratum.llm.exact_dedup import exact_dedup
from stratum.llm.html_wrappers import extract_pages
from stratum.llm.licenses import license_scan
from stratum.llm.mixing import mix
from stratum.llm.ngram_join import Block, ngram_components
from stratum.llm.pii import pseudonymise
from stratum.llm.quality import POLICIES, ablations, apply_policy, ledger
from stratum.llm.secrets import ACCESS, ASSIGN, HEX, secret_scan
from stratum.llm.url_rules import judge_urls

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, body string, n long, key string, "
          "id string, h string, grp string, words string")
RNG = random.Random(3)
VOCAB = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 8))) for _ in range(400)]


def sentence(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def rows():
    base = sentence(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, base), (1, base.replace(" ", "\t\n", 3)), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n"),
        (6, "four words only here"), (7, "FOUR words only HERE"), (8, sentence(60, 2)), (8, sentence(60, 2)),
        (None, sentence(50, 3)), (None, base), (9, sentence(12000, 4)), (10, "x" * 50000), (11, "wörter ümlaut 漢字 " * 40),
        (12, sentence(60, 2) + " tail"), (13, "one"), (14, " one"), (15, " "), (16, " " * 3000 + "a"),
        (17, "\n".join([sentence(10, 5)] * 12)),
    ]
    return [(i, t, "en", [None, "s1", "s2"][k % 3], 0, 99, "b", 1, "k", "z", "h", "g", "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(ascii_lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup(docs, first_digit=8, growth=4).collect()
    assert len(got) == len(rows())
    by_sha = {}
    for r in got:
        by_sha.setdefault(r["text_sha256"], []).append(r)
    assert {hashlib.sha256(t.encode()).hexdigest() for t in groups} == set(by_sha)
    for t, ids in groups.items():
        group = by_sha[hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert {r["group_size"] for r in group} == {len(ids)}
        assert {r["keep_id"] for r in group} == {min(known) if known else None}
        kept = [r for r in group if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == (min(known) if known else None)
    assert exact_dedup(none).count() == 0


def brute_components(pairs):
    """Smallest id reachable by links, by repeated relaxation."""
    comp = {k: k for k in range(len(pairs))}
    sets = [shingles(t) for _, t in pairs]
    links = [(a, b) for a, b in itertools.combinations(range(len(pairs)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    out = []
    for k, (_, t) in enumerate(pairs):
        ids = [pairs[j][0] for j in comp if comp[j] == comp[k] and pairs[j][0] is not None]
        out.append((pairs[k][0], len(sets[k]), min(ids) if ids else None))
    return out


def order(rows_):
    return sorted(rows_, key=lambda r: tuple((x is not None, x) for x in r))


def test_ngram_components(docs, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(docs).collect()]
    assert order(got) == order(brute_components([(r[0], r[1]) for r in rows()]))
    assert ngram_components(none).count() == 0


def test_ngram_chains_and_families(spark):
    """Chains of near copies, families around the threshold, and a passage that all share."""
    rng = random.Random(8)
    pairs, passage = [], sentence(60, 77).split()
    for family in range(6):
        text = sentence(90, 100 + family).split()
        for k in range(25):
            text = list(text)
            for _ in range(rng.choice((0, 1, 2, 4))):
                text[rng.randrange(len(text))] = rng.choice(VOCAB)
            pairs.append((len(pairs), " ".join(text if k % 2 else text + passage)))
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()]
    want = brute_components(pairs)
    assert order(got) == order(want)
    assert len({w[2] for w in want}) > 6


def test_block_search_is_exact():
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60)
    sets = []
    for _ in range(80):
        s = base.copy()
        k = rng.integers(0, 30)
        s[rng.choice(60, k, replace=False)] = rng.integers(0, 1 << 40, k)
        sets.append(np.unique(s[:rng.integers(2, 61)]))
    block = Block(sets)
    for q in sets:
        want = [m for m, s in enumerate(sets)
                if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert list(block.search(q)) == want


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 105: 100, 103: 100}


def brute_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_ledger(docs, none):
    table = apply_policy(ledger(docs))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
            r["base_failed"]) for r in table.collect()]
    want = []
    for r in rows():
        m = brute_measures(r[1])
        want.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert order(got) == order(want)
    assert apply_policy(ledger(none)).count() == 0
    assert not table.where("base_failed and kept").count()


def test_ablations_match_the_ledger(docs):
    table = ledger(docs).cache()
    masks = [r["failed"] for r in table.collect()]
    for r in ablations(table).collect():
        policy = POLICIES[r["policy"]].mask
        own = 1 << [n for n, _ in __import__("stratum.llm.quality", fromlist=["RULES"]).RULES].index(r["rule"])
        assert r["n_failed"] == sum(bool(m & policy & own) for m in masks)
        assert r["n_only"] == sum(m & policy == own for m in masks)
        assert r["n_kept"] == sum(not m & policy for m in masks)
        assert r["n_kept_without"] == sum(not m & policy & ~own for m in masks)
    table.unpersist()


def test_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = encode_documents(docs, keep_ids=True).collect()
    assert order([(r["doc_id"], tuple(r["ids"])) for r in got]) == order(
        [(r[0], tuple(enc.encode_ordinary(r[1] or ""))) for r in rows()])
    sha = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows()}
    assert {r["decoded_sha256"] for r in got} == sha
    long = "".join(random.Random(1).choices(["word ", "it's  ", "\n\n ", "12 ", "!? ", "é à", "  \t x"], k=30000))
    assert encode(long, rank_file()) == enc.encode_ordinary(long)
    assert encode_documents(none).count() == 0


def test_mix(docs, none):
    result = mix(docs, block_words=4).collect()
    assert order([(r["doc_id"], r["size"]) for r in result]) == order([(r[0], len(words(r[1]))) for r in rows()])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in result)
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    names = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = dict(zip(names, (5, 2, 1), strict=False))
    whole, capped = sum(sizes.values()), set()
    while True:
        rest = whole - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    by_size = {sizes[s]: (target[s], s) for s in names}
    taken = {}
    for r in result:
        goal, s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(goal)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 16 + 0.02 * target[s] for s in names)
    again = mix(docs.repartition(5), block_words=4).collect()
    assert order([(r["doc_id"], r["size"], r["taken"]) for r in again if r["doc_id"] != 8]) == \
        order([(r["doc_id"], r["size"], r["taken"]) for r in result if r["doc_id"] != 8])
    assert mix(none).count() == 0


def test_licenses(spark, none):
    texts = [(1, "This work is licensed under the GNU General Public License, version 3. CC-BY cc by"), (2, None), (3, ""),
             (4, "Copyright (c) 2020 Some Body. All rights reserved."), (5, "Licensed under the Apache License, Version 2.0"),
             (6, "licensed under the apache licence version 2.0"), (7, "ALL RIGHTS all rights reserved " * 2), (None, "CC BY")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "cc-by,gpl,gpl-3.0" and got[1]["n_base"] == 3 and got[1]["first_word"] == 7
    assert got[4]["labels"] == "copyright-notice,reserved" and got[5]["labels"] == "apache-2.0"
    assert got[6]["labels"] == "" and got[6]["score"] == 0 and got[2]["n_words"] == 0 and got[3]["first_word"] is None
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 2, 7)
    assert got[None]["base_labels"] == "cc-by" and got[None]["score"] == 0.5
    assert license_scan(none).count() == 0


def test_secrets(spark, none):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    texts = [(1, f"Password = 'abc123' token:x AKIA{'A' * 16} {'0a' * 12}"), (2, f"nothing {key} here"),
             (3, f"user: bob\nkey {key} at https://x.example.com/login"), (4, f"user: bob {'word ' * 200} {key}"),
             (5, None), (6, ""), (7, "user: bob"), (8, "é API_KEY=ééé apikey=1234567"), (8, "é API_KEY=ééé apikey=1234567")]
    df = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, row string, kind string")
    got = {r["doc_id"]: r for r in secret_scan(df).collect()}
    for i, t in texts:
        base = sorted([(m.start(), 0, m.end()) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 6]
                      + [(m.start(), 1, m.end()) for m in ACCESS.finditer(t or "") if len(m[0]) >= 20]
                      + [(m.start(), 2, m.end()) for m in HEX.finditer(t or "") if len(m[0]) >= 24])
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(b[1] == k for b in base) for k in range(3)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    assert got[2]["spans"] == got[4]["spans"] == got[7]["spans"] == got[5]["spans"] == ""
    assert [s.split(":")[0] for s in got[3]["spans"].split(",")] == ["login", "key", "endpoint"]
    assert secret_scan(df).count() == len(texts) and secret_scan(none).count() == 0


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_pii(spark, none):
    card, bad = "4041894974608795", "4041894974608796"
    texts = [(1, f"a {card} b {bad} c"), (2, f"{card}"), (3, "mail bob.12@mail6.example.com now"), (4, "42.144.35.254 and 300.1.1.1"),
             (5, "+1 (988) 555-2485"), (6, "2001-02-30 1999-12-31"), (7, None), (8, ""), (9, "plain text"), (None, "bob.12@mail6.example.com")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, hits string")
    got = {r["doc_id"]: r for r in pseudonymise(df).collect()}
    new = got[2]["text"]
    assert new != card and len(new) == 16 and luhn(new) and got[1]["text"] == f"a {new} b {bad} c"
    mail = re.fullmatch(r"mail ([a-z]{3}\.\d{2})@mail6\.example\.com now", got[3]["text"])
    assert mail and mail[1] != "bob.12" and got[None]["text"].startswith(mail[1] + "@")
    ip = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)\.(\d+) and 300\.1\.1\.1", got[4]["text"])
    assert ip and all(int(x) < 256 for x in ip.groups()) and got[4]["n_ip"] == 1 and "42.144.35.254" not in got[4]["text"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[5]["text"]) and got[5]["text"] != "+1 (988) 555-2485"
    assert re.fullmatch(r"2001-02-30 \d{4}-\d\d-\d\d", got[6]["text"]) and "1999-12-31" not in got[6]["text"]
    assert got[7]["text"] == got[8]["text"] == "" and got[9]["text"] == "plain text"
    assert pseudonymise(none).count() == 0


def test_pii_is_a_permutation(spark):
    """All values of a small format have different pseudonyms."""
    df = spark.range(10000).select(F.col("id").alias("doc_id"), F.format_string("m%02d%02d@x.example.com", F.floor(F.col("id") / 100), F.col("id") % 100).alias("text"))
    out = pseudonymise(df)
    assert out.select("text").distinct().count() == 10000
    assert out.where(~F.col("text").rlike(r"^[a-z]\d{4}@x\.example\.com$")).count() == 0


def test_urls(spark):
    urls = [(0, "HTTP://A.Example.COM/en/1"), (1, "https://example.com/en/2?x=1"), (2, "https://www.example.com/en/3#t"),
            (3, "http://m.host.net/fr/x"), (4, "http://m.host.net/de/x"), (5, None), (6, "no scheme"), (7, "http://x.com"),
            (8, "http://x.org?q"), (9, "://"), (9, "://"), (None, "http://y.net/es/")]
    pages = spark.createDataFrame([(*u, "", "z") for u in urls], "page_id long, url string, html string, rule string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in judge_urls(pages, none).collect()}
    want = {0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("example.com", "/en/2", "example.com/en/", "block"),
            2: ("www.example.com", "/en/3", "www.example.com/en/", "allow"), 3: ("m.host.net", "/fr/x", "net/fr/", "block"),
            4: ("m.host.net", "/de/x", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
            7: ("x.com", "", None, "allow"), 8: ("x.org", "", None, "allow"), 9: ("", "", None, "allow"),
            None: ("y.net", "/es/", "net/es/", "block")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want
    assert judge_urls(pages, none).count() == len(urls)
    assert judge_urls(pages.limit(0), none).count() == 0


def test_url_rules_are_mined(spark):
    """Pages of one section with a tracking key are bad; the pair is the rule, not its parts."""
    data, marks = [], []
    for i in range(400):
        section, key = ("spam" if i % 2 else "news"), ("aff" if i % 4 < 2 else "page")
        data.append((i, f"http://h{i % 7}.org/{section}/{i}?{key}=1", ""))
        if i % 3:
            marks.append((i, 0 if section == "spam" and key == "aff" else 1, 0))
    out = judge_urls(spark.createDataFrame(data, "page_id long, url string, html string"),
                     spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {i for i in range(400) if i % 2 and i % 4 < 2}
    assert {r["method_rule"] for r in out} == {None, "key:aff & path:spam"}


def page(body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
            f'<nav><ul><li><a href="/">Home</a></li><li><a>x</a></li></ul></nav><div class="ad">Buy</div>{extra}'
            f"<article>{body}</article><footer>&copy; f</footer></body></html>")


def test_html(spark):
    pages = [
        (0, "http://a.org/1", page("<h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three</p>")),
        (1, "http://a.org/2", page("<h1>Other</h1><p>Text &lt;b&gt;</p>", "<aside>side</aside><form>f</form>")),
        (2, "http://b.org/1", None), (3, None, page("<p>no host</p>")), (4, "http://b.org/2", ""),
        (5, "http://a.org/3", page("<p>cut of")[:-40]), (6, "http://a.org/4", page('<p>body</p><div class="comments"><p>c</p></div>')),
        (7, "http://c.org/1", "<div class='menu'>m</div><p>plain</p><p>page</p>"), (7, "http://c.org/1", "<p>plain</p>"),
        (8, "http://d.org", page("<p>" + "word " * 30000 + "</p>")),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {}
    for r in extract_pages(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[0] == ["Head & line\nOne two.\nThree"] and got[1] == ["Other\nText <b>"]
    assert got[2] == got[4] == [""] and got[3] == ["no host"] and got[6] == ["body"]
    assert got[5][0].startswith("cut of") and sorted(got[7]) == ["plain", "plain\npage"]
    assert got[8] == [("word " * 30000).strip()]
    assert extract_pages(df.limit(0)).count() == 0
