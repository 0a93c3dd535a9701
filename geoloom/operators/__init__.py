"""Operators over a Dataset; each returns a DataFrame."""
