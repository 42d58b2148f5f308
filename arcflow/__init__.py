"""Graph ranking on Spark DataFrames."""
