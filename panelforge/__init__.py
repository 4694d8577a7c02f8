"""Spark-native analytics for threshold panels and large text corpora."""
