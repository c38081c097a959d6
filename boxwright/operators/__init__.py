"""Joins, aggregations and window jobs over the canonical tables."""
