"""Queries over the test tables: every operator next to equivalent SQL."""
