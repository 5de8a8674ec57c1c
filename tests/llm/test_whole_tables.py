"""Queries without SQL against brute force over the whole smallest tables."""

import hashlib
import html
import re

from stratum.llm.html_wrappers import op8_html_wrappers
from stratum.llm.pii import op2_pii_pseudonyms
from stratum.llm.secrets import op9_secret_links
from stratum.llm.url_rules import op3_url_rules
from stratum.llm.ngram_join import op4_ngram_jaccard
from tests.conftest import SF001, SF01
from tests.llm.test_small_cases import brute_components, luhn, order


def documents(spark, sf=SF001):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_pii_is_replaced_everywhere(spark):
    docs, links = documents(spark, SF01), {}
    pattern = re.compile(r"[a-z.0-9]+@[a-z0-9.]+[a-z]|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|"
                         r"\+1 \(\d{3}\) \d{3}-\d{4}")
    found = 0
    for r in op2_pii_pseudonyms(spark, SF01).collect():
        old, new = pattern.findall(docs[r["doc_id"]]), pattern.findall(r["text"])
        assert len(old) == len(new)
        assert pattern.split(docs[r["doc_id"]]) == pattern.split(r["text"])  # all else stays
        for a, b in zip(old, new, strict=True):
            if re.fullmatch(r"\d{16}", a) and not luhn(a):
                assert a == b
                continue
            found += 1
            assert links.setdefault(a, b) == b and re.sub(r"\d+", "9", a.split("@")[-1]) == re.sub(r"\d+", "9", b.split("@")[-1])
            assert a != b and (not re.fullmatch(r"\d{16}", b) or luhn(b))
    assert found > 20 and len(set(links.values())) == len(links)


def test_pages_give_their_documents(spark):
    """Every page shows a headline and the lines of the document in its url."""
    docs = documents(spark, SF01)
    urls = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in op8_html_wrappers(spark, SF01).collect():
        text = docs[int(re.search(r"/(\d+)", r["url"].split("://")[1])[1])]
        want = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
        head = " ".join(html.unescape(re.search(r"<h1>(.*?)</h1>", urls[r["page_id"]], re.S)[1]).split())
        assert r["text"].split("\n") == [head, *want]


def test_secret_bases(spark):
    docs = documents(spark, SF01)
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in op9_secret_links(spark, SF01).collect():
        t = docs[r["doc_id"]]
        base = sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
                      + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
                      + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_url_verdicts(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for r in op3_url_rules(spark, SF01).collect():
        fits = [(h + p, v) for h, p, v in rules
                if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert r["rule"] == rule
        assert r["verdict"] == (verdict or ("block" if r["method_rule"] else "allow"))


def test_near_copies_whole_table(spark):
    docs = documents(spark)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op4_ngram_jaccard(spark, SF001).collect()]
    assert order(got) == order(brute_components(sorted(docs.items())))
