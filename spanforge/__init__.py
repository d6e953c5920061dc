"""Spark-first analytics for timestamped media signals."""

__version__ = "0.1.0"
