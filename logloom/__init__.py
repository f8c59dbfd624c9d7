"""Log compression and analytics on Spark DataFrames."""
