"""Code-graph analytics and hybrid retrieval on Spark DataFrames."""
