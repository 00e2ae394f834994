"""Spark-native analytics over document and code corpora."""

__version__ = "0.1.0"
