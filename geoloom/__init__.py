"""Spark-native analytics over road-network data, and tools for text corpora."""
