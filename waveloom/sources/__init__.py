"""Readers of recordings and their metadata."""
