"""Document processing and entity resolution at corpus scale, on Spark DataFrames."""
