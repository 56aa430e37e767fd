"""A code-graph analytics engine on Spark DataFrames."""
