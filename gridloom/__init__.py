"""Sparse-factorization analytics and corpus preparation on Spark DataFrames."""
