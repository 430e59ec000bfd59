"""Registered queries and their DuckDB counterparts."""
