"""Loomspark: analytics over collections of short texts, on Spark DataFrames."""
