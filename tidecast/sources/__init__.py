"""Readers, writers and run tables."""
