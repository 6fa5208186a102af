"""Corpus statistics, retrieval and ranking over Spark DataFrames."""
