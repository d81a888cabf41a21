"""Spark-first catalog search, dataset and training-data engine."""
