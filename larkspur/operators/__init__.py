"""Operators over catalog tables: each takes and gives DataFrames."""
