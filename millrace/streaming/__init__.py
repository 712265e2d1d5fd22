"""Structured Streaming queries over the events table."""
