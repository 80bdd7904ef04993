"""Operators for building training text, and the queries that apply them."""
