"""Isolated sessions and versioned tables for concurrent clients."""
