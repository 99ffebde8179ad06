"""Operators over price, offer and catalogue tables."""
