"""Station classification from site metadata, built on Spark DataFrames and Spark ML."""
