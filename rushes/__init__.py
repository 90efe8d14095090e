"""Rushes: Spark-native analytics over observations made about media files."""

__version__ = "0.1.0"
