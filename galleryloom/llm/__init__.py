"""Operators for training-data pipelines, their queries and SQL."""
