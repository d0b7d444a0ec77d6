"""Multiway (tensor) data analytics on Spark DataFrames."""
