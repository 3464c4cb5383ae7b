"""Readers, writers and generators of series."""
