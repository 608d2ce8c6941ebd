"""Column-level building blocks (text, ids, coercions, Unicode)."""
