"""Docstring-drift analytics as Spark DataFrame jobs."""
