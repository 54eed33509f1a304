"""Spark-native text de-identification and text-table operators."""
