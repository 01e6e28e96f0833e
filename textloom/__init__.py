"""textloom: text-flow analytics on Spark DataFrames."""
