"""Part of the foliant engine."""
