"""Scalar functions as Column builders and plain Python."""
