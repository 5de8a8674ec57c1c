"""Column-expression helpers (JVM-side, codegen-friendly)."""

from stratum.functions.exprs import (  # noqa: F401
    grade_expr, grade_name_expr, draw_position, squared_distance, subset_text,
    GRADE_NAMES,
)
