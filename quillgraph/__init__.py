"""Spark-native scholarly-graph analytics."""
