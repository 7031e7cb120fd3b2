"""Spark-native analytics for internal-link audits of web sites."""

__version__ = "0.1.0"
