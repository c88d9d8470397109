"""Spark-native analytics over collections of vectors."""
