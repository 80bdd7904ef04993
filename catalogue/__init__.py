"""Queries over the driver tables, each with an independent SQL statement of its result."""
