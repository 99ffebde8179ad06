"""Composite plans and the query registry."""
