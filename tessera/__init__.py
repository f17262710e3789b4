"""Spark-native engine for hybrid retrieval over document corpora."""
