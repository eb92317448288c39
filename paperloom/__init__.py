"""Spark-native literature evidence analytics."""

__version__ = "0.1.0"
