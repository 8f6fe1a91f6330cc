"""Readers that turn files into the logical tables."""
