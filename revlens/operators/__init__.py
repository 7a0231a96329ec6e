"""Operators of the review engine."""
