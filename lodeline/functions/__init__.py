"""Columns and column-like building blocks."""
