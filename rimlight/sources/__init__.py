"""Readers and writers, and inputs derived from the given tables."""
