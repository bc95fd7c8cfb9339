"""Column expressions and, where a scan is sequential, Arrow-batched functions."""
