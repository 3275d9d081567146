"""Evaluate text labelling at scale with Spark DataFrames."""
