"""Structured Streaming forms of the run, attempt and outbox operators."""
