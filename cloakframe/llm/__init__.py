"""Operators of a training-data pipeline: quality, toxicity, language, near-duplicates, mixing, sharding, packing."""
