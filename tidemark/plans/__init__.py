"""Queries over the fixture tables, with their SQL."""
