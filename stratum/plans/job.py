"""The whole job in one call: read, scale, find neighbours, grade, cross-validate, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratum.operators.cell_tree import knn_tree
from stratum.operators.grading import minority_types
from stratum.operators.knn import knn, knn_cells, knn_pruned
from stratum.operators.prepare import feature_ranges, min_max_scale, to_indexed
from stratum.plans.experiment import run_experiment
from stratum.plans.grading import graded, scaled_points
from stratum.plans.vote_grid import vote_grid_metrics
from stratum.sources.files import load_or_compute, read_table, write_results
from stratum.sources.manifest import made_from


def fold_grader(k: int):
    """A ``regrade`` for ``run_experiment``: ranges and neighbours from the training rows only."""

    def regrade(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        ranges = feature_ranges(train)
        return minority_types(min_max_scale(train, ranges=ranges), k), min_max_scale(test, ranges=ranges)

    return regrade


def run_job(spark: SparkSession, path: str, save: str, *, label_col: str, index_col: str | None = None,
            schema: T.StructType | None = None, header: bool = True, fmt: str = "csv", k: int = 5,
            methods: Sequence[str] = ("none", "undersample", "oversample", "smote"), num_splits: int = 5,
            seed: int = 42, model: str = "forest", search: str = "tree", n_cells: int = 16, nprobe: int = 4,
            per_fold: bool = False, pool: str = "class", parallel_fits: int = 4, recall: float = 0.9,
            mode: str = "compute", minority: str | None = None) -> DataFrame:
    """Run the grid on the table at ``path``, write one result folder per fold below ``save``
    and return the written result table.

    ``search`` names the neighbour search of the grading: ``tree`` (two-level cells probed as
    deep as ``recall`` asks, the default), ``exact`` (all pairs), ``pruned`` (exact, by cells
    with radii) or ``cells`` (approximate, ``nprobe`` of ``n_cells``). ``mode`` ``write``
    saves the graded table at ``minority`` with a manifest, ``read`` takes it from there and
    refuses one of other input files or parameters (S6).
    ``per_fold`` scales and grades each fold from its training rows alone; ``pool`` is what
    SMOTE+ draws from. ``model`` is ``forest``, or ``vote`` for the deterministic stand-in,
    which has neither SMOTE+ nor ``per_fold``.
    """
    source = read_table(spark, path, schema, header, fmt)
    points = to_indexed(source, label_col, index_col=index_col)

    def graded_table() -> DataFrame:
        def compute() -> DataFrame:
            return _graded(points, k, search, n_cells, nprobe, seed, recall)
        if mode == "compute":
            return compute()
        origin = made_from(source, label=label_col, index=index_col, k=k, search=search, n_cells=n_cells, nprobe=nprobe,
                           seed=seed, recall=recall)
        return load_or_compute(spark, mode, minority, compute, "parquet", origin)

    if model == "vote":
        if per_fold or "smotePlus" in methods:
            raise ValueError("the vote model runs the plain grid only")
        res = vote_grid_metrics(graded_table(), methods, k, num_splits, seed)
    elif model == "forest":
        # with per_fold the rows are graded inside the folds
        table = points if per_fold else graded_table()
        res = run_experiment(table, methods=methods, num_splits=num_splits, seed=seed, pool=pool,
                             parallel_fits=parallel_fits, regrade=fold_grader(k) if per_fold else None)
    else:
        raise ValueError("model is 'forest' or 'vote'")
    write_results(res, save)
    return spark.read.option("header", True).schema(res.schema).csv(save).select(*res.columns)


def _graded(points: DataFrame, k: int, search: str, n_cells: int, nprobe: int, seed: int, recall: float) -> DataFrame:
    if search == "exact":
        return graded(points, k)
    scaled = scaled_points(points)
    find = {"tree": lambda: knn_tree(scaled, k, n_cells, recall, seed=seed),
            "pruned": lambda: knn_pruned(scaled, k, n_cells, seed=seed),
            "cells": lambda: knn_cells(scaled, k, n_cells, nprobe, seed=seed)}
    return minority_types(scaled, k, find[search]())
