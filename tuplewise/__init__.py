"""Relational algebra with true set semantics on Spark DataFrames."""
