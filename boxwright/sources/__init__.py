"""Readers that turn annotation formats into the canonical tables."""
