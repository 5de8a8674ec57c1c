"""Operator 5: rule bitmask ledger for quality rules (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a versioned mask over those bits, so policies are applied,
compared and ablated on the ledger alone, with bitwise operations and no second look at
the texts.

All measurements are taken inside the row, so a text never crosses a shuffle. Eight-word
windows are compared by a 64-bit hash of their words' hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import SPACE_CLASS, WORD_PATTERN, read_table, text_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rules in bit order: name, and the SQL condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    # up to two may be a headline; long lines that stand again fail repeated_windows, which goes by words
    ("repeated_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "2 * n_upper > word_chars and n_words >= 20"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("stutter", "100 * n_stutter > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "many_symbols", "repeated_lines")),
    Policy("v2", tuple(name for name, _ in RULES)),
)}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_stutter")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer never inlines them into a lambda."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """``doc_id`` and the measurements of the whole text (null text: no words).

    With ``whole_row`` also ``doc``, the input row as a struct.
    """
    text, carried = F.col("text"), ["doc"] if whole_row else []
    df = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"),
                     *[F.struct("*").alias(c) for c in carried])
    df = _barrier(
        df,
        words=F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)),
        lines=F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        word_chars=F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long"),
        n_symbols=_count(text, f"[{SYMBOLS}]"),
        n_upper=_count(text, r"\p{Lu}"),
    ).drop("text")
    df = _barrier(
        df,
        hashes=F.transform("words", lambda w: F.xxhash64(w)),
        n_words=F.size("words").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    ).drop("words", "lines")
    eight = ", ".join(f"get(hashes, i + {k})" for k in range(-1, WINDOW - 1))
    df = _barrier(
        df,
        windows=F.expr(f"if(n_words < {WINDOW}, array(), transform(sequence(1, cast(n_words as int) - {WINDOW - 1}), "
                       f"i -> xxhash64({eight})))"),
        n_stutter=F.expr("cast(size(filter(hashes, (h, i) -> i > 0 and h = get(hashes, i - 1))) as bigint)"),
    ).drop("hashes")
    df = _barrier(df, ordered=F.expr(
        "if(size(array_distinct(windows)) = size(windows), cast(array() as array<struct<h: bigint, p: int>>), "
        "array_sort(transform(windows, (h, i) -> struct(h as h, i as p))))")).drop("windows")
    df = _barrier(df, places=F.expr(
        "array_sort(transform(filter(transform(ordered, (x, i) -> struct(x.p as p, "
        "coalesce(get(ordered, i - 1).h = x.h, false) or coalesce(get(ordered, i + 1).h = x.h, false) as again)), "
        "y -> y.again), y -> y.p))")).drop("ordered")
    covered = F.expr(f"aggregate(places, 0L, (a, x) -> a + {WINDOW}) - "
                     f"aggregate(transform(places, (x, i) -> greatest(0, {WINDOW} - (get(places, i + 1) - x))), 0L, "
                     "(a, x) -> a + coalesce(x, 0))")
    return df.withColumn("n_repeat_words", covered).select("doc_id", *MEASURES, *carried)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: bit i is set where rule i fails.

    Defined cases: null and empty texts have no words and fail ``too_few_words``; a null id
    stays null; repeated rows give repeated results; an empty table gives an empty result;
    further columns are ignored whatever their names.
    """
    failed = " | ".join(f"if({cond}, {1 << i}L, 0L)" for i, (_, cond) in enumerate(RULES))
    return measured(docs, id_col, text_col, whole_row).withColumn("failed", F.expr(failed))


def apply_policy(df: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``base_failed``, ``policy`` and ``kept`` from the failure bits of a ledger."""
    bad = F.col("failed").bitwiseAND(F.lit(POLICIES[version].mask)) != 0
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return df.withColumns({"base_failed": base, "policy": F.lit(version), "kept": ~base & ~bad})


def ablations(df: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, fails alone, and kept without it.

    The ledger is first counted by its failure bits (at most 2 to the number of rules rows).
    """
    masks = df.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    grid = [(p.version, p.mask, r, BIT[r]) for p in POLICIES.values() for r in p.rules]
    table = F.inline(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"),
                                        F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"))
                               for v, m, r, b in grid]))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (masks.select("failed", "n", table).groupBy("policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_only"),
        count(hit == 0).alias("n_kept"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without")))


def keep_documents(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    return apply_policy(ledger(docs, id_col, text_col, whole_row=True), version).where("kept").select("doc.*")


def op5_quality_ledger(spark, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(read_table(spark, sf_dir, "documents")))


OP5_MEASURES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, list_slice(words, i, i + 7) AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
             len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutter
      FROM w LEFT JOIN cov USING (rid))
"""
OP5_SQL = OP5_MEASURES_SQL + ", f AS (SELECT *, (" + " + ".join(
    f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, (_, cond) in enumerate(RULES)) + rf""")::BIGINT AS failed FROM m)
SELECT *, (failed & {BASE.mask}) != 0 AS base_failed, '{CURRENT}' AS policy,
       (failed & {BASE.mask | POLICIES[CURRENT].mask}) = 0 AS kept
FROM f
"""
