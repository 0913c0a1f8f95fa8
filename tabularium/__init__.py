"""Spark-native analytics for messy business tables."""
