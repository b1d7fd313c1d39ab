"""seekspark: hybrid search, its evaluation and corpus preparation on Spark DataFrames."""
