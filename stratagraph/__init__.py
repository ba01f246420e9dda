"""Spark-native analytics over property graphs of software systems."""

__version__ = "0.1.0"
