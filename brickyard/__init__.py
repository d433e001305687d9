"""Spark-native document, price and retrieval analytics."""
