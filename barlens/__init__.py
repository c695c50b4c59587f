"""Research on market bars with Spark DataFrames."""
