"""Spark-native analytics for longevity genomics."""
