"""Parquet tables and CSV sources/sinks for ordered tables."""
