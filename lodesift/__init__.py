"""Secret and sensitive-content scanning on Spark DataFrames."""

__version__ = "0.1.0"
