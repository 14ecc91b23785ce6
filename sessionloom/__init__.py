"""Spark-native analytics over AI-coding session logs."""
