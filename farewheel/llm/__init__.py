"""Operators for training-data pipelines: scoring, deduplication, mixing, encoding, search."""
