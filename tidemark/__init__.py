"""Factor analytics on Spark DataFrames."""
