"""Operator 9: secret scan with multipart credential linking.

One pass over the texts finds the base secrets and, beside them, weak candidates that say
nothing alone: login names, random-looking strings and endpoints. Then an interval join
links access identifiers with secrets that stand within one scope (``SCOPE`` characters)
of the same document, and endpoints with such pairs. Weak candidates are reported only
where their complementary parts co-occur; base secrets are always reported.

Only parts (kind, start, end) leave the pass, never texts. The interval join is an
equi-join on document and scope-sized bucket, so no group grows beyond a bucket's parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, stage, text_of

#: Span kinds in listed order: the base kinds, then those that need a partner.
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("login", "key", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
IDENTIFIERS = ("access", "login")
SECRETS = ("assign", "hex", "key")
#: Characters between two parts of one credential at most.
SCOPE = 300
#: Bits per character that a weak key must reach.
KEY_ENTROPY = 3.5


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile(f"({_either_case('password|passwd|secret|token|api_?key')})"
                    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
HEX_LONG = re.compile("[0-9a-f]{24,}")
LOGIN = re.compile(f"(?<![A-Za-z])({_either_case('user|user_?name|login|account|client_?id|access_?key_?id')})"
                   r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""")
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Looked for once for each run of a scheme's characters, so a long run costs its length; group 1 is where it begins.
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])[0-9+.-]*([A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+)""")

#: Translations that turn a text's characters of a class into x, for a fast first look.
_HEX_RUN = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_KEY_RUN = bytes(0x78 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 0x20 for b in range(256))
_KEYWORDS = ("passw", "secret", "token", "api")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base secrets in code points, sorted."""
    found = []
    lower = raw.lower()
    if (b":" in raw or b"=" in raw) and any(w.encode() in lower for w in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_HEX_RUN):
        # the longest runs of 24 or more are the maximal runs: shorter ones hold no match
        found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def weak_spans(text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of candidates that overlap no base secret, sorted."""
    found, logins = [], []
    if b":" in raw or b"=" in raw:
        logins = [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)] if re.search("(?i)user|login|account|client|access", text) else []
    if b"x" * 20 in raw.translate(_KEY_RUN):
        # a login's own value is no secret that goes with it
        inside = {i for a, _, b in logins for i in range(a, b)}
        found += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if m.start() not in inside
                  and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])
                  and entropy(m[0]) >= KEY_ENTROPY]
    if b"://" in raw:
        found += [(m.start(1), 5, m.end()) for m in ENDPOINT.finditer(text)]
    found = sorted(logins + found)
    out, i = [], 0
    for s in found:
        while i < len(base) and base[i][2] <= s[0]:
            i += 1
        if not any(b[0] < s[2] and s[0] < b[2] for b in base[i:i + 2]):
            out.append(s)
    return out


def parts_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, base_sha256, base, weak``: spans as arrays of structs (start, kind, end)."""
    span = "array<struct<start:long,kind:int,stop:long>>"
    ddl = (f"row long, doc_id {docs.schema[id_col].dataType.simpleString()}, base_sha256 string, base {span}, "
           f"weak {span}")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    as_dicts = lambda spans: [{"start": a, "kind": k, "stop": b} for a, k, b in spans]

    def run(batches):
        for batch in batches:
            digests, bases, weaks = [], [], []
            for value in batch.column(2):
                raw = value.as_py()
                text = raw.decode()
                base = base_spans(text, raw)
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                digests.append(hashlib.sha256(line.encode()).hexdigest())
                bases.append(as_dicts(base))
                weaks.append(as_dicts(weak_spans(text, raw, base)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(bases, kind),
                 pa.array(weaks, kind)], names=["row", "doc_id", "base_sha256", "base", "weak"])

    return docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"),
                       text_of(docs, text_col).cast("binary").alias("body")).mapInArrow(run, ddl)


def _within(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Interval join: parts of one document with at most ``scope`` characters between them.

    Every left part is looked for in the buckets its widened interval touches, every right
    part is filed under the buckets it covers itself.
    """
    near = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope), F.floor(hi / scope)))
    a = left.select("row", F.struct("start", "kind", "stop").alias("a"),
                    near(F.col("start") - scope, F.col("stop") + scope).alias("bucket"))
    b = right.select("row", F.struct("start", "kind", "stop").alias("b"),
                     near(F.col("start"), F.col("stop")).alias("bucket"))
    close = (F.col("b.start") <= F.col("a.stop") + scope) & (F.col("a.start") <= F.col("b.stop") + scope)
    return a.join(b, ["row", "bucket"]).where(close).select("row", "a", "b").distinct()


def _of(parts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return parts.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with their partners in scope: ``row, start, kind, stop``.

    An identifier needs a secret, a secret an identifier; an endpoint needs either part of
    such a pair.
    """
    pairs = _within(_of(parts, IDENTIFIERS), _of(parts, SECRETS), scope)
    members = pairs.select("row", F.explode(F.array("a", "b")).alias("s")).select("row", "s.*").distinct()
    ends = _within(members, _of(parts, ("endpoint",)), scope).select("row", "b.*").distinct()
    return members.where(F.col("kind") >= len(BASE_KINDS)).unionByName(ends)


def _line(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``.

    Defined cases: null and empty texts have no spans (empty string, and the digest of the
    empty string); a null id stays null; repeated rows are scanned and linked each for
    itself; an empty table gives an empty result; further columns are ignored.
    """
    table = stage(parts_table(docs, id_col, text_col))
    # only documents with a weak candidate can get a link
    parts = (table.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s"))
             .select("row", "s.*"))
    more = (linked(parts, scope).groupBy("row")
            .agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more")))  # of one document's text
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return table.join(more, "row", "left").select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], "base_sha256",
        _line(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"),
        F.coalesce(F.when(F.col("more").isNotNull(), F.size("more")), F.lit(0)).cast("long").alias("n_linked"))


def op9_secret_links(spark, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))
