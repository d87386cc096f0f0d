"""Page-region analytics on Spark."""
