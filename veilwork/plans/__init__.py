"""Iterated pipelines and user hooks."""
