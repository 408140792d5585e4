"""Interval and variant analytics on Spark DataFrames, with operators for training-data corpora."""
