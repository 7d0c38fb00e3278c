"""Spark-native engine for curating, scoring, partitioning and evaluating text-and-code training data."""

__version__ = "0.1.0"
