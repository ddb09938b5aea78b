"""Larkspur: file-catalog and content-search analytics on PySpark."""
