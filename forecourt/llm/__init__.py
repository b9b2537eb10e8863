"""Operators for training-data pipelines: scans, sharding, packing, deduplication, archives."""
