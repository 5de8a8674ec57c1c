"""Plans: end-to-end pipelines (grading, experiment grid) and the registered queries."""
