"""Spark-native analytics over code graphs, repository health and the text that surrounds them."""

__version__ = "0.1.0"
