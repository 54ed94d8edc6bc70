"""Fact-drift analytics on Spark DataFrames."""
