"""Scalar and statistical functions."""
