"""Sources and sinks: driver tables, derived indexed tables, CSV/parquet round trips."""
