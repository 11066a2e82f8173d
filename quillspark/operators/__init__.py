"""Operators as functions from DataFrames to DataFrames, to be composed with ``transform``."""
