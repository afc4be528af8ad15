"""Weighted-graph analytics on Spark DataFrames."""
