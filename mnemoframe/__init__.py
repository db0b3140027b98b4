"""Spark-native analytics for dense, repeated-measures experiments."""
