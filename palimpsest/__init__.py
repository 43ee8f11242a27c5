"""Spark engine that scans, redacts, verifies and plans over document corpora."""

__version__ = "0.1.0"
