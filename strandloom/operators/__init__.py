"""DataFrame operators: interval joins and set algebra, coverage, read pipeline, ranking."""
