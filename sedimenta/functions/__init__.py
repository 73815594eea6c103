"""Column functions: text, JSON, row spelling, credentials."""
