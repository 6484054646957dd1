"""Spark-native analytics over collections of articles and documents."""
