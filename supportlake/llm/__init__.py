"""Operators for preparing language-model training data, each a function on DataFrames."""
