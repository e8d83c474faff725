"""Retrieval, ranking, dedup, text and state operators on Spark DataFrames."""
