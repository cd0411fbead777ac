"""Operators of a training-data pipeline: dedup, license scans, revisits, quality, URL lists, mixing,
decontamination, near-dedup, token files and media columns. Nothing else in the library imports this package."""
