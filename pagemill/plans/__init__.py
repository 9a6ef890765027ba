"""What to extract and how: intents, plans, and the backends that make plans."""
