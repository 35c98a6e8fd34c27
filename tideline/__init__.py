"""Spark-native analytics over ordered media-event timelines."""
