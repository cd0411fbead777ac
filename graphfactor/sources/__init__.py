"""Reading nested tables, storing containers."""
