"""Spark-native media-metadata transforms."""
