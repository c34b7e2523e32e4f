"""Dialect queries over Structured Streaming sources."""
