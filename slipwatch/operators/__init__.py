"""Operators: every function here maps DataFrames to DataFrames."""
