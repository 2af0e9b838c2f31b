"""Spark-native analytics for gridded, time-stamped data."""
