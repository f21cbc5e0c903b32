"""Spark-native terminology mapping: index build, retrieval, feature scoring, ranking and export."""

__version__ = "0.1.0"
