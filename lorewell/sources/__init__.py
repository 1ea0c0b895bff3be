"""Readers and importers."""
