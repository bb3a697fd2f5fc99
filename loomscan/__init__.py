"""Spark-first analytics over source code metrics and text corpora."""
