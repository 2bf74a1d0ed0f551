"""tessera: dense index-space analytics on Spark DataFrames."""
