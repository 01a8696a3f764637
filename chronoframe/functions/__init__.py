"""Numerics on aggregated results: distribution tails, test tables, Gram solves."""
