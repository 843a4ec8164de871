"""Spark-native analytics for network-security evidence."""
