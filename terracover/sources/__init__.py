"""Readers and deterministic fixture views."""
