"""Operators of a training-data pipeline: fixity, deduplication, scans, search, mixing, packing, quality."""
