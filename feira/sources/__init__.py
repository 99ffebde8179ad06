"""Readers of captured feeds and tables."""
