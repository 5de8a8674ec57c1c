"""The wavelet matrix by plain counting; cuts and forms by brute force on odd texts."""

import hashlib
import re

import numpy as np
import pytest

from stratum.llm.fill_middle import UNITS, WaveletMatrix, fill_in_middle, restored

SCHEMA = "doc_id long, text string, n long, form string, output string, body string, prefix_chars string"
ENDS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+",
        "sentences": r"[^\n.!?]*[\n.!?]|[^\n.!?]+"}


def test_matrix_counts_and_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 5, n).astype(np.uint8)
        matrix, places = WaveletMatrix(codes), np.arange(n + 1)
        for code in range(6):
            want = np.concatenate(([0], np.cumsum(codes == code)))
            assert (matrix.rank(code, places) == want).all()
        both = np.concatenate(([0], np.cumsum((codes == 1) | (codes == 3))))
        assert (matrix.count((1, 3), places) == both).all()
        wanted = np.arange(both[-1] + 1)
        found = matrix.behind((1, 3), wanted, np.zeros_like(wanted), np.full_like(wanted, n))
        assert (found == [int(np.flatnonzero(both == w)[0]) for w in wanted]).all()


def brute(i, text, unit, rate, spm):
    text = text or ""
    units = re.findall(ENDS[unit], text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or h[2] % 100 >= rate or re.search("<[PSM]>", text):
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    texts = [None, "", "\n", "\n\n", "a", "a\nb", "a\nb\n", "no end.\r\nü 漢字\n🙂 x! y?\n" * 5, "<P>\nx", "x<S\n>", "<", "P>\n<S",
             "line\n" * 3000, "z" * 3_000_000, "word " * 600_000, "漢\n" * 400]
    some = [(k, t) for k, t in enumerate(texts)] + [(None, "a\nb\nc"), (4, "a"), (4, "a"), (-3, "q\nr\ns\n")]
    return some + [(100 + k, "".join(f"row {j}.\n" for j in range(k % 9))) for k in range(60)]


@pytest.mark.parametrize("unit,rate,spm", [("lines", 100, 50), ("words", 60, 100), ("sentences", 100, 0)])
def test_cuts_by_brute_force(spark, unit, rate, spm):
    assert set(UNITS) == set(ENDS)
    docs = spark.createDataFrame([(i, t, 1, "f", "o", "b", "p") for i, t in rows()], SCHEMA).repartition(2)
    out = fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    got = out.select("*", restored("output", "form").alias("back")).collect()
    want = [(*brute(i, t, unit, rate, spm), t or "") for i, t in rows()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
