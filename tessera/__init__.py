"""Spark-native time-series analytics: role-typed tables, count-based chunks, codecs and filtered averages."""

__version__ = "0.1.0"
