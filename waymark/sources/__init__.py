"""Readers of dirty CSV text."""
