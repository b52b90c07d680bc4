"""Detection analytics on Spark DataFrames."""
