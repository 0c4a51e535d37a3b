"""Longitudinal analysis of versioned components on Spark DataFrames."""
