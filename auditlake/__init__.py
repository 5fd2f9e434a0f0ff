"""Evidence scanning and compliance analytics on Spark DataFrames."""
