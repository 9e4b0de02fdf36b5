"""Spark-native repository-intelligence analytics."""
