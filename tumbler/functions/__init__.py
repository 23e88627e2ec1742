"""Exact combinatorics and small column helpers."""
