"""Composed queries: registered by name with their SQL."""
