"""Spark-native indexing, retrieval and analytics over collections of source files and documents."""
