"""Market-research analytics on Spark."""
