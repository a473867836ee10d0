"""Nearest-neighbour transaction scoring on Spark DataFrames."""
