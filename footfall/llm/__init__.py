"""Operators for preparing training data: mixing, filtering, deduplication, tokenizing, extraction and search."""
