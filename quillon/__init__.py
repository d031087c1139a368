"""quillon: annotation evaluation and document analytics on Spark DataFrames."""
