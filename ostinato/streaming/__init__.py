"""Rhythm statistics over streams."""
