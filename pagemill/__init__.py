"""pagemill: web pages to typed, quality-scored tables, as DataFrame transformations."""
