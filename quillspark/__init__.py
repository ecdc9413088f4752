"""Query-driven document analytics on Spark DataFrames."""
