"""Data-quality measurement, validation, cleaning and comparison on Spark DataFrames."""
