"""Operators: pure functions from DataFrames to DataFrames; time and policies are arguments."""
