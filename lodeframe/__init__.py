"""Spatial and similarity analytics on Spark DataFrames and Structured Streaming."""
