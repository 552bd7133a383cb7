"""textloom: corpus analytics on Spark DataFrames."""
