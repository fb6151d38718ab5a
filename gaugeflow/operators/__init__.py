"""Operators on DataFrames. Nothing here collects rows; iterative ones run a job a round and write what they carry over."""
