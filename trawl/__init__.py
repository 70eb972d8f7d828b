"""Spark-native retrieval and indexing analytics: DataFrames in, DataFrames out."""
