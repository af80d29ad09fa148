"""Retention and logistics analytics on Spark.

Every operator is a function from DataFrames (and parameters) to a
DataFrame, built from Spark's own expressions so that Catalyst plans it.
"""

__version__ = "0.1.0"
