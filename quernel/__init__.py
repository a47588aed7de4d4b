"""Spark-native corpus and single-table query engine."""

__version__ = "0.1.0"
