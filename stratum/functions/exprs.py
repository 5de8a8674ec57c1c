"""Reusable Column expressions.

Everything here is a built-in Spark expression evaluated on the JVM. The higher-order ones
(``transform``, ``zip_with``, ``aggregate``) are interpreted, not part of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade codes and their names, in grade order.
# 0 safe, 1 borderline, 2 rare, 3 outlier.
GRADE_NAMES = ("safe", "borderline", "rare", "outlier")


def grade_expr(same: Column | str, k: Column | int) -> Column:
    """Grade from the number of same-class neighbours among k.

    share >= 0.8 -> 0 safe, >= 0.4 -> 1 borderline, >= 0.2 -> 2 rare, else 3 outlier.
    Written on integers (5*same >= 4*k, ...) so no float rounding enters.
    """
    same = F.col(same) if isinstance(same, str) else same
    k = F.lit(k) if isinstance(k, int) else k
    five = same * 5
    return (
        F.when(five >= k * 4, F.lit(0))
        .when(five >= k * 2, F.lit(1))
        .when(five >= k, F.lit(2))
        .otherwise(F.lit(3))
    )


def grade_name_expr(grade: Column | str) -> Column:
    """Name of a grade code (NULL for codes outside 0..3, e.g. synthetic -1)."""
    grade = F.col(grade) if isinstance(grade, str) else grade
    out = None
    for code, name in enumerate(GRADE_NAMES):
        out = F.when(grade == code, name) if out is None else out.when(grade == code, name)
    return out


# Hex digits of an md5 that make a draw: 60 bits, the most that a signed long holds whole.
DRAW_DIGITS = 15


def hash_number(key: Column) -> Column:
    """The first 60 bits of the md5 of ``key`` as a long."""
    return F.conv(F.substring(F.md5(key), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def draw_position(n: Column, seed: int, *parts: Column | str) -> Column:
    """Deterministic pseudo-random position in [0, n) from a hash of the key parts.

    md5 of ``seed:part1:part2:...``; the first 15 hex digits as a 60-bit integer, modulo n
    (the bias is below n / 2^60). No RNG state, so the draw does not depend on partitioning
    or task order, and it is reproducible in any SQL engine with md5.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.pmod(hash_number(key), n.cast("bigint"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two equal-length double arrays, summed left to right."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def subset_text(types: Column | str) -> Column:
    """``[0 1 3]`` text of a grade subset, as the result table prints it."""
    types = F.col(types) if isinstance(types, str) else types
    return F.concat(F.lit("["), F.array_join(F.transform(types, lambda t: t.cast("string")), " "),
                    F.lit("]"))
