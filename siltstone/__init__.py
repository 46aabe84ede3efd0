"""Spark-first analytics over log-structured key-value change logs."""

__version__ = "0.1.0"
