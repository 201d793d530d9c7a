"""Spark-native analytics for document knowledge bases."""
