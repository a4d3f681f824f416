"""Spark-native validation and reshaping of multi-table datasets."""
