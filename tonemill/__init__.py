"""Spark-native dictionary and tone analytics for document collections."""

__version__ = "0.1.0"
