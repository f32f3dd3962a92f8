"""Palisade: security-event analytics on Spark DataFrames."""
