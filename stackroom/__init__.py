"""Hierarchical document search and analytics on Spark DataFrames."""
