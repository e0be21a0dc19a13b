"""Spark-native invoice extraction and analytics."""
