"""From query texts to DataFrames."""
