"""Spark-native analytics for time-ordered, per-frame coordinate data."""

__version__ = "0.1.0"
