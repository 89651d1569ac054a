"""Marketplace analytics and table jobs on Spark DataFrames."""
