"""Registered queries with their comparison SQL, over views of the given tables."""
