"""Spark-native analytics for raw sequencing signal: reads, signal chunks and run information."""
