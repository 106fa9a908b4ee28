"""Incremental cell counts."""
