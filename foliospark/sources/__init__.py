"""Part of foliospark: sources."""
