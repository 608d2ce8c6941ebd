"""Structured Streaming jobs over logs and landed documents."""
