"""Spark-native evaluation analytics and text-curation operators."""
