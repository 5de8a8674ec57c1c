"""Personal values with numbers beside them, and the whole table of sf0.1."""

import re

import pytest
from pyspark.sql import functions as F

from stratum.llm.pii import op2_pii_pseudonyms, pseudonymise
from tests.llm.test_small_cases import luhn
from tests.llm.test_whole_tables import documents

SF1 = "/root/testdata/sf0.1"
CARD, AMEX, SPACED = "4111111111111111", "378282246310005", "4111 1111 1111 1111"
PHONE, IP, DATE, MAIL = "+1 (555) 555-0123", "1.43.173.185", "1999-12-31", "12bob@x.example.com"
BESIDE = [
    (f"{SPACED} 12/27", [SPACED]), (f"{CARD} 123", [CARD]), (f"5 {CARD}", [CARD]), (f"1234 {CARD} 12", [CARD]),
    (f"{CARD} {IP}", [CARD, IP]), (f"{CARD} {CARD}", [CARD, CARD]), (f"{SPACED} {SPACED}", [SPACED, SPACED]),
    (f"{SPACED} {AMEX}", [SPACED, AMEX]), (f"{AMEX} 1234", [AMEX]), (f"7 {SPACED} 99", [SPACED]),
    (f"{SPACED} {DATE}", [SPACED, DATE]), (f"12 {DATE} 1999", [DATE]), (f"{SPACED} {MAIL}", [SPACED, MAIL]),
    (f"{PHONE} 42", [PHONE]), (f"{PHONE} {IP}", [PHONE, IP]), (f"{PHONE} {DATE}", [PHONE, DATE]), (f"{PHONE} {CARD}", [PHONE, CARD]),
    (f"+44 20 7946 0958 {IP}", ["+44 20 7946 0958", IP]), (f"+44 20 7946 0958 {CARD}", ["+44 20 7946 0958", CARD]),
    (f"+44 20 7946 0958 {MAIL}", ["+44 20 7946 0958", MAIL]), ("4242 555-555-0123", ["555-555-0123"]),
]


@pytest.fixture(scope="module")
def alone(spark):
    values = sorted({v for _, parts in BESIDE for v in parts})
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return {values[r["doc_id"]]: r["text"] for r in pseudonymise(df).collect()}


def test_values_beside_numbers(spark, alone):
    """Each value is found and has the pseudonym that it has alone; what stands beside it stays."""
    assert all(a != b for a, b in alone.items())
    df = spark.createDataFrame([(i, f"a {t}, b") for i, (t, _) in enumerate(BESIDE)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonymise(df).collect()}
    for i, (text, parts) in enumerate(BESIDE):
        want, at = "", 0
        for p in parts:
            want += text[at:text.index(p, at)] + alone[p]
            at = text.index(p, at) + len(p)
        assert got[i]["text"] == f"a {want}{text[at:]}, b", text
        assert got[i]["n_pii"] == len(parts), text


def test_other_groupings(spark):
    odd = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "41111111 11111111", "1234 5678 4111 11111111 1111", "1 2 3 4 5 6 7 8 9 1 2 3 4 5"]
    df = spark.createDataFrame(list(enumerate(odd)) + [(9, "7" * 5000), (10, "1 " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_card"]) for r in pseudonymise(df).collect()}
    assert [got[i][1] for i in range(4)] == [1, 1, 1, 0] and got[2][0].startswith("1234 5678 ")
    assert all(luhn(re.sub(r"\D", "", got[i][0])) for i in (0, 1)) and got[3][0] == odd[3]
    assert got[9][0] == "7" * 5000 and len(got[10][0]) == 10000


def test_nothing_stays_in_clear(spark):
    """sf0.1: every phone, address, mail name and valid card of the documents is replaced."""
    docs = documents(spark, SF1)
    value = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)|[a-z.0-9]+@[a-z0-9.]+[a-z]")
    found, links = 0, {}
    for r in op2_pii_pseudonyms(spark, SF1).where(F.col("text").rlike("[0-9]")).collect():
        old, new = value.findall(docs[r["doc_id"]]), value.findall(r["text"])
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            if not (re.fullmatch(r"\d{16}", a) and not luhn(a)):
                found += 1
                assert a != b and links.setdefault(a, b) == b
    assert found > 500
