"""Incremental state over streams."""
