"""Genotype-by-exposure analytics on Spark DataFrames."""
