"""Column functions, token counters and embedders."""
