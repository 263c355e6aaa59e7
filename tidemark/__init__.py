"""Spark-native analytics over time-series panels and text corpora."""
