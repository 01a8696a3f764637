"""Fixtures derived from the given tables, registered queries and their DuckDB oracles."""
