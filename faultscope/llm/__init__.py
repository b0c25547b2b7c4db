"""Operators for training corpora: counting, cleaning, deduplication, formatting, mixing, sharding."""
