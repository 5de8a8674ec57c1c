"""Entry A of the workload: scale, find neighbours, grade."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from stratum.operators.grading import minority_types
from stratum.operators.knn import knn
from stratum.operators.prepare import feature_ranges, min_max_scale
from stratum.session import reliable_checkpoint


def scaled_points(points: DataFrame, persist: bool = True, with_count: bool = False):
    """P6 over an indexed table. The narrow input is persisted first so the range scan and
    every later use (neighbour search reads it several times) share one computation.
    With ``with_count`` returns ``(scaled, row count)``; the count comes from the same job."""
    if persist:
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
    mins, maxs, n = feature_ranges(points, with_count=True)
    scaled = min_max_scale(points, ranges=(mins, maxs))
    return (scaled, n) if with_count else scaled


def graded(points: DataFrame, k: int = 5, neighbours: DataFrame | None = None,
           persist: bool = True) -> DataFrame:
    """Scaled + graded minority table ``index, label, minority_type, features``.

    By default written to the shared checkpoint folder (``reliable_checkpoint``): folds,
    grids and resampling read it many times; each read would otherwise repeat the neighbour
    search, and every plan built on it would carry (and re-analyse) the whole lineage.
    """
    if neighbours is None:
        scaled, n = scaled_points(points, with_count=True)
        neighbours = knn(scaled, k, n_rows=n)
    else:
        scaled = scaled_points(points)
    g = minority_types(scaled, k, neighbours)
    return reliable_checkpoint(g) if persist else g
