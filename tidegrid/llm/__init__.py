"""Operators for training data: percentiles, distinct counts, token ids, mixing, splitting. Nothing outside this package imports it."""
