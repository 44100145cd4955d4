"""Batch operators: DataFrames in, DataFrames out, all keys at once."""
