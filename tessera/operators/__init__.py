"""Operators over DataFrames: index, boolean search, scoring, grouping, analytics, recommendation, learning."""
