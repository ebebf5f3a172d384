"""Operators: DataFrames in, DataFrame out, lazy and without side effects."""
