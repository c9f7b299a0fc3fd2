"""Readers of structure files and coordinate tables."""
