"""Streams of candidate rounds."""
