"""Factoring streams."""
