"""Structured Streaming: the journal source and route progress."""
