"""Property-graph queries on Spark DataFrames."""
