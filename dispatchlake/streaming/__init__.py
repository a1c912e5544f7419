"""Structured Streaming jobs over capture folders that keep growing."""
