"""Operators of a training-data pipeline: sharding, filters, deduplication, packing, tokens, fingerprints, extraction."""
