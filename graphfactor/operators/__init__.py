"""Factoring nested records into entity lists, and rebuilding them."""
