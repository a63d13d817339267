"""Structured Streaming forms of the windows and of scoring."""
