"""Analysis operators: DataFrames in, lazy DataFrames out."""
