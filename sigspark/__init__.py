"""sigspark: analytics over communication traces and other event data, on Spark DataFrames."""

__version__ = "0.1.0"
