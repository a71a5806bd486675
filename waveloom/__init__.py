"""Spark-first analytics for sampled signals, event grids and large text corpora."""
