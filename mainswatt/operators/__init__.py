"""Operators: each takes and returns DataFrames keyed by (site, channel)."""
