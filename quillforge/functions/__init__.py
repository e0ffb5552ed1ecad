"""Column expressions: text normalization, answer comparison, identities."""
