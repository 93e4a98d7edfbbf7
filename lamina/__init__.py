"""Multi-resolution slicing, retrieval and token-budget packing on Spark DataFrames."""
