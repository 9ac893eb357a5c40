"""Spark-native analytics for match records, schedules and the corpora built from them."""

__version__ = "0.1.0"
