"""Spark-native hybrid retrieval, text analytics and evaluation operators."""
