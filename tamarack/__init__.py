"""Spark-native vector, keyword and hybrid retrieval over collections of records."""

__version__ = "0.1.0"
