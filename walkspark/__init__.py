"""Spark jobs that build and query a grounded catalogue of published walks."""
