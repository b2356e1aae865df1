"""Data-protection analytics on Spark DataFrames and streams."""
