"""Sequence comparison and periodicity detection on Spark DataFrames."""
