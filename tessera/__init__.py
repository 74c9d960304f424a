"""Feature matching and verification analytics on Spark DataFrames."""
