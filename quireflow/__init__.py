"""Mining collections of scientific documents with Spark DataFrames."""
