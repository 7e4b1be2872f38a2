"""parchmine: document analytics on Spark DataFrames."""
