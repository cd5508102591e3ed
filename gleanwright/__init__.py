"""Keyword-evidence analytics on PySpark."""
