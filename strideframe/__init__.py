"""Motion-capture analytics on Spark DataFrames."""
