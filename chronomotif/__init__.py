"""Temporal-motif analytics and corpus preparation on Spark DataFrames."""
