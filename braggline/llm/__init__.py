"""Operators of a training-data pipeline: mixing, screening, de-duplication, sharding, archives, tokens."""
