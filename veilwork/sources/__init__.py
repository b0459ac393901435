"""Sources, sinks and intermediate tables."""
