"""Streaming of the signal engine."""
