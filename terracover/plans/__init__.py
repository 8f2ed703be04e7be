"""Assembled queries and their SQL oracles."""
