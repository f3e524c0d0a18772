"""Helpers that shape physical plans: lineage cuts and bounded side tables."""
