"""Queries on streams."""
