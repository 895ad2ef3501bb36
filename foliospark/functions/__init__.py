"""Part of foliospark: functions."""
