"""Panel, tape and quote analytics on Spark DataFrames."""
