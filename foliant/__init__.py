"""foliant: documents, postings and tracker events as Spark DataFrames."""
