"""Spark-native analytics on panels of daily, sparsely observed sequences."""
