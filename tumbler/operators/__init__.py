"""Operators: each takes tables and returns a table; none runs a job by itself unless it says so."""
