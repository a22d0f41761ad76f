"""A retrieval and document analytics engine on Spark DataFrames."""
