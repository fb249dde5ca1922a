"""Operators on DataFrames: each takes frames and returns one, and leaves joins and shuffles to Spark's planner."""
