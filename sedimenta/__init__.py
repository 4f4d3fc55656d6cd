"""Carving and analysing raw evidence with Spark."""

__version__ = "0.1.0"
