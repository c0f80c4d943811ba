"""Spark-first text analysis: documents to aligned tokens, search terms and positional postings."""

__version__ = "0.1.0"
