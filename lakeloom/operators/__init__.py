"""Operators that Spark has under no name of its own, as functions from DataFrames to DataFrames."""
