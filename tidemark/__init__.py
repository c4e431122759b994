"""Spark-native event-study and strategy-validation engine."""
