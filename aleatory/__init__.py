"""Spark-native analytics for random and symbolic data streams."""
