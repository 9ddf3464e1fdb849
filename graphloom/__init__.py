"""Spark-native analytics over repository knowledge graphs."""
