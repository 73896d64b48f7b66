"""A Spark-first engine for daily-bar strategy research."""

__version__ = "0.1.0"
