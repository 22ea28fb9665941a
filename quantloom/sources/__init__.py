"""Sources of the signal engine."""
