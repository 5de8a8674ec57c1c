"""Operators: preparation, neighbours, grading, resampling, clustering, models, metrics."""
