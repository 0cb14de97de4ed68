"""Operators over memory points, each a function from DataFrames to a DataFrame."""
