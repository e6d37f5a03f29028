"""Spark-native analytics for ordered measurement data."""
