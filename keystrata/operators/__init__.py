"""Operators over versioned logs: merge, read, sketch, verify, limit."""
