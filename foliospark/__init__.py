"""Document-page analytics on Spark."""
