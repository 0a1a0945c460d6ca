"""Operators of the corpus library."""
