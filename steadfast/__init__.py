"""Outlier-resistant statistics on Spark DataFrames."""
