"""Reading tables, lookups and texts, and writing results."""
