"""Readers, identities, admission, append-only sinks and ownership checks."""
