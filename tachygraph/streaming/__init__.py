"""Structured Streaming forms of the window features, for live sources."""
