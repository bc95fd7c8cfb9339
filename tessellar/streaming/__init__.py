"""Streams: file ingestion without repeats, latency of the last samples, running ledger totals."""
