"""Readers, writers and the content-addressed store."""
