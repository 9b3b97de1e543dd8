"""Layered retail mart on PySpark: two raw feeds in, dimensions, facts and windowed summaries out."""
