"""Part of the header engine."""
