"""Spark-native text, vector and retrieval analytics."""
