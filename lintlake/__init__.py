"""Code, log and dependency analytics as ordinary Spark DataFrame jobs."""

__version__ = "0.1.0"
