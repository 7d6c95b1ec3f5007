"""Operators for training-data pipelines: deduplication, filters, mixing, tokens, sharding."""
