"""Set-similarity joins and term statistics on Spark DataFrames."""
