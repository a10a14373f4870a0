"""Structured Streaming versions of the live behaviour."""
