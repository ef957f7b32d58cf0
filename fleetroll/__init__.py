"""Fleet-lifecycle analytics on Spark: DataFrames in, DataFrames out."""
