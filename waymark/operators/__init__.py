"""Relational operators on point tables."""
