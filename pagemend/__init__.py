"""Analysis and repair of multi-pass text recognition on Spark DataFrames."""
