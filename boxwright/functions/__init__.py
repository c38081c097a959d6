"""Column builders (no Python UDF)."""
