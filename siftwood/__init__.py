"""Document-forensics and text analytics on Spark DataFrames."""
