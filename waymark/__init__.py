"""Waymark: find the places that matter to a customer, as Spark DataFrame operators."""
