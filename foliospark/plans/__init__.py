"""Part of foliospark: plans."""
