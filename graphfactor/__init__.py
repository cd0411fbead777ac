"""Factor nested records into flat, deduplicated entity tables, and rebuild them."""
