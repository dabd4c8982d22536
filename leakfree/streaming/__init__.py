"""Structured Streaming twins of the batch log analytics (STR-1..6)."""
