"""Spark-native document retrieval, grounding analytics and corpus processing."""
