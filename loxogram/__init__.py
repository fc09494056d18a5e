"""Spatio-textual analytics on Spark DataFrames."""
