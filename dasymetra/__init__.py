"""Spark-native point-to-area disaggregation and the data processing around it."""
