"""Prose auditing and stylometry on Spark DataFrames."""
