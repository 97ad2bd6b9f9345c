"""Sales response analytics on Spark DataFrames."""
