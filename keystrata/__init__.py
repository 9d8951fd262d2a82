"""Versioned-record analytics on PySpark."""
