"""Spark-native analytics over ordered, frame-like records."""
