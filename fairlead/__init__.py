"""Fairlead: vessel-traffic analytics on Spark DataFrames."""
