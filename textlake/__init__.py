"""textlake: full-text search and ranking over Spark DataFrames."""

__version__ = "0.1.0"
