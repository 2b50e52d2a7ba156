"""Queries and the public functions."""
