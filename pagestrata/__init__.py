"""Spark-native analytics over captured page evidence."""

__version__ = "0.1.0"
