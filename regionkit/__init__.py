"""Spark-native engine for dense and region-based retrieval and its evaluation."""
