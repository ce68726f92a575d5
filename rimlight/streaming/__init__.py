"""Structured Streaming forms of the event handlers."""
