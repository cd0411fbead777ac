"""Names of lists, columns and fields."""
