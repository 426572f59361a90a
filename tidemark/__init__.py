"""Market time-series research on Spark: canonical tables, bars, factors, labels, analytics."""
