"""Operators of the analysis: quality checks, exploration, cohort,
logistics profiles and marts. Each is a DataFrame -> DataFrame function."""
