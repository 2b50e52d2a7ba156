"""Readers of bulletins and station files."""
