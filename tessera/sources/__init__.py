"""Readers, writers and written intermediate tables."""
