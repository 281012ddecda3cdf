"""Typed, cache-style tables and corpus operators on PySpark."""
