"""Spark-native digest of log incidents."""
