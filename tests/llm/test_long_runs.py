"""Texts of one long run end, and what stands beside the run is still found."""

import random
import re

from stratum.llm.pii import pseudonymise
from stratum.llm.secrets import ENDPOINT, secret_scan


def test_dotted_names_of_any_length(spark):
    texts = ["a@" + "a." * 50_000, "a@" + "a." * 2_000, "a." * 50_000 + "@a.com", "mail bob@" + "x1." * 100 + "org now",
             "a@" + "-" * 100_000 + ".com", "write to ann@mail.example.com today"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pseudonymise(rows, key="k").collect()}
    assert got[0] == texts[0] and got[1] == texts[1]
    assert got[3] != texts[3] and got[3].startswith("mail ") and got[3].endswith(" now")
    assert "ann@mail.example.com" not in got[5] and got[5].startswith("write to ") and got[5].endswith(" today")


def test_letter_run_beside_a_link(spark):
    texts = ["see http://a.example/x " + "q" * 1_000_000, "q1-" * 300_000 + " see http://a.example/x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(secret_scan(rows).collect()) == 2


def test_endpoints_by_the_plain_pattern():
    plain = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+""")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "Z", "1", "+", ".", "://", " ", "<", "'", "é", "/", "-"], k=rng.randint(1, 25)))
        assert [(m.start(1), m.end()) for m in ENDPOINT.finditer(text)] == [m.span() for m in plain.finditer(text)]
