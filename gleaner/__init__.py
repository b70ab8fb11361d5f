"""Spark-native text retrieval, evaluation and corpus statistics."""
