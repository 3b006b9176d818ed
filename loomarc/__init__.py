"""Spark-native analytics for feed and web-content archives."""
