"""Incremental maintenance of diversity sums."""
