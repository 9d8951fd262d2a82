"""Logs over tables, and logs and runs on storage."""
