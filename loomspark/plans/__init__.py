"""Schemas, dependency order, row counts and configuration. All of it is metadata of tens of tables, on the driver."""
