"""A governed analytics engine whose queries are Spark DataFrames."""
