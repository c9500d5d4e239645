"""Spark-native analytics for sensitive spans, training dynamics and leakage in code corpora."""

__version__ = "0.1.0"
