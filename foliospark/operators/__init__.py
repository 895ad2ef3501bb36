"""Part of foliospark: operators."""
