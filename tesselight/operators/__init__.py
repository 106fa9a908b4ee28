"""Operators over categorical frames."""
