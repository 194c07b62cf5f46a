"""Document processing and retrieval over Spark DataFrames."""
