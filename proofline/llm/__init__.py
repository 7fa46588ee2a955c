"""Operators of a training-data pipeline: dedup, extraction, sharding, mixing, tokens, fingerprints."""
