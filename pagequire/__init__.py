"""Layout-and-text analytics over paginated documents, on Spark DataFrames."""
