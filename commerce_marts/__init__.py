"""Retail analytics on PySpark: staging tables, curated marts and the operators around them."""

__version__ = "0.1.0"
