"""Readers, writers and table layout."""
