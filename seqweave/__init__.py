"""Spark-native sequence similarity, clustering and text-corpus engine."""
__version__ = "0.1.0"
