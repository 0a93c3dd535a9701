"""Changeset files as a stream."""
