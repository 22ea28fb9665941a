"""Functions of the signal engine."""
