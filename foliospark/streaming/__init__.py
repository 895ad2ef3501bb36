"""Part of foliospark: streaming."""
