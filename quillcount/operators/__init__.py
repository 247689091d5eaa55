"""Operators over DataFrames of sources, models and runs."""
