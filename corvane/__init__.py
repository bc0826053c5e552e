"""Corvane: batched hybrid retrieval, temporal state and corpus processing on PySpark DataFrames."""
