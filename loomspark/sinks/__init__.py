"""Sinks: CSV, SQL text, JDBC, JSON and previews."""
