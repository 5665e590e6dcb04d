"""Telltale: machine-style text scoring and corpus preparation on Spark DataFrames."""
