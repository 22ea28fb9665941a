"""Operators of the signal engine."""
