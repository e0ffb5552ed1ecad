"""Operators over flat tables: blocks, extraction, reconciliation, review, grading, runs."""
