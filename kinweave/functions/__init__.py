"""Scalar functions over text."""
