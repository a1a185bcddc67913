"""Shared plan pieces: size-checked joins, block windows, the query catalogue, derived tables."""
