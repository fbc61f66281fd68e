"""Bilingual text analytics on Spark DataFrames."""
