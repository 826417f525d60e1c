"""Matching and scoring operators: DataFrames in, DataFrames out."""
