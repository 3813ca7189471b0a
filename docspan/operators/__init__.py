"""Operators: pure functions from relation to relation."""
