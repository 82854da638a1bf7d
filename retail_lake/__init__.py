"""Retail and marketing analytics as plain PySpark DataFrame code."""
