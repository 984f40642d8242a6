"""Relational and statistical operators on DataFrames."""
