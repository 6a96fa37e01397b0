"""Spark-native retrieval, scoring, ranking and training-data operators."""
