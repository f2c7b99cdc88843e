"""Queries over the driver's tables, with the same in DuckDB's SQL."""
