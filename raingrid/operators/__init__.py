"""Operators on cubes: DataFrames keyed by time and cell."""
