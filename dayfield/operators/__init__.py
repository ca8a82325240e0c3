"""Operators: DataFrames in, a DataFrame out, explicit keys."""
