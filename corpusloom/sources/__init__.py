"""Readers and writers for the library's tables."""
