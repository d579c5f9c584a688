"""Folianto: full-text search and corpus processing for book collections, on PySpark."""

__version__ = "0.1.0"
