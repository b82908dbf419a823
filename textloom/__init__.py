"""Spark-first analytics over document corpora and tables."""
