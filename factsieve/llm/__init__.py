"""Operators for building training data at scale: scoring, deduplication, search, mixing, output."""
