"""Parlance: Spark-native operators for multilingual documents and conversations."""
