"""Spark-native phonetic fuzzy search over collections of short texts."""
