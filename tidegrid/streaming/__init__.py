"""Structured Streaming ingest and the upkeep of its block directories."""
