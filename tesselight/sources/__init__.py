"""Readers and frames."""
