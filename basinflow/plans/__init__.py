"""Configured runs: settings, caches and the order of operators."""
