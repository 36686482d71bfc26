"""Spark-native operators for content-event data."""
