"""Private and synthetic corpus curation on Spark."""
