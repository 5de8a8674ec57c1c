"""Operators of a training-data pipeline: deduplication, filtering, mixing, tokenisation.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its queries only
when it is present.
"""
