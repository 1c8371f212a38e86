"""Hot-topic text analytics on Spark DataFrames."""
