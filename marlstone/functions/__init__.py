"""Part of the typed XML engine."""
