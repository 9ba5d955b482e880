"""Spark-native retrieval, ranking and text-data analytics."""

__version__ = "0.1.0"
