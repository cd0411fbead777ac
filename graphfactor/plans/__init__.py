"""Type catalogs, configuration and analysis: everything decided before a query runs."""
