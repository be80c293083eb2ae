"""Structure discovery on numeric feature tables, as Spark DataFrames."""
