"""Spark-native analytics for multi-view measurement data."""
