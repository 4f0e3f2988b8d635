"""Structured Streaming forms of the resumable steps."""
