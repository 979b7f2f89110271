"""Operators: DataFrames in, DataFrames out, no actions unless a docstring says so."""
