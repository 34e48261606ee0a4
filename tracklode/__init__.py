"""Spark-native analytics over nested trajectory and scenario data."""
