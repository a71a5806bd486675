"""Operators over sample, grid and label tables."""
