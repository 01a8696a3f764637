"""Structured Streaming forms of existing operators (carry-forward per subject)."""
