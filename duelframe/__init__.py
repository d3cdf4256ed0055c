"""Spark-native analytics for paired outcomes: two opposed baskets of items and a score."""
